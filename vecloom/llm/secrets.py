"""Operator 5 (native): secret scans by patterns and by a battery of randomness tests.

Candidates are long runs of token characters that hold a letter and a digit. Their encoding is inferred (hex, base32,
base62, base64), and with the encoding's alphabet of K symbols a battery tests a run of length L for randomness:
chi-squared uniformity of the symbols, the number of runs above and below the middle of the alphabet, and the serial
correlation of neighbours. A run counts as random if no test rejects it. As short runs give tests little power, each
run also gets the probability p that writing would look so even: chi-squared of writing is shifted by `excess` * L, so
p falls with the length. The false discoveries among reported runs are held to `rate` by the Benjamini-Hochberg step in
each stratum of encoding and length, from a histogram of all candidates' log p, which is small whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.shared import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run's end does not move: as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings: name, pattern, alphabet, and how much more often than in random text two symbols of writing agree.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.0),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.0),
    ("base64", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
]
KINDS = ["assign", "access", "hex", "random"]
BINS = 400
_SPAN = "struct<kind:int,start:int,end:int,body:string>"
_SPANS = f"array<{_SPAN}>"


def once(value: str, name: str, then: str) -> str:
    """SQL: then, with value worked out once under that name."""
    return f"transform(array({value}), {name} -> {then})[0]"


def scanned(items: str, step, kind: str, carry: str = "0") -> str:
    """SQL: what step gives for the items of an array in order. step(t, x), with t.carry from the item before, gives SQL
    for the next carry and for an array of results. Items are taken in stretches of about the root of their number, so
    results are not copied once an item."""
    after, found = step("t", "x")
    stretch = f"greatest(16, cast(ceil(sqrt(size({items}))) as int))"
    inner = f"""aggregate(slice({items}, i * {stretch} + 1, {stretch}), named_struct('carry', s.carry, 'out', cast(array() as array<{kind}>)),
        (t, x) -> named_struct('carry', {after}, 'out', concat(t.out, {found})))"""
    return f"""aggregate(sequence(0, cast(floor(size({items}) / {stretch}) as int)), named_struct('carry', {carry}, 'out', cast(array() as array<array<{kind}>>)),
        (s, i) -> {once(inner, "y", "named_struct('carry', y.carry, 'out', concat(s.out, array(y.out)))")}, s -> flatten(s.out))"""


def spans_of(text: str, pattern: str, kind: int, group: int = 0) -> str:
    """SQL: the matches of pattern as (kind, start, end, body), in code points. body is the group's text. Places are sums
    of the lengths of what lies between matches and of the matches."""
    like = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = f"zip_with(transform(split({text}, {like}, -1), x -> length(x)), zip_with(regexp_extract_all({text}, {like}, 0), regexp_extract_all({text}, {like}, {group}), (m, b) -> named_struct('size', length(m), 'body', b)), (g, m) -> named_struct('gap', g, 'size', m.size, 'body', m.body))"

    def step(t: str, x: str) -> tuple[str, str]:
        begin = f"{t}.carry + {x}.gap"
        one = f"array(named_struct('kind', {kind}, 'start', {begin}, 'end', {begin} + {x}.size, 'body', {x}.body))"
        return f"{begin} + coalesce({x}.size, 0)", f"if({x}.size is null, cast(array() as {_SPANS}), {one})"

    return f"if({text} rlike {like}, {once(parts, 'p', scanned('p', step, _SPAN))}, cast(array() as {_SPANS}))"


def untouched(base: str, runs: str) -> str:
    """SQL: the runs that no span of base overlaps, by one pass over both in order of their starts. Runs do not overlap
    each other: what begins inside one is a span of base."""
    item = lambda run: f"x -> named_struct('start', x.start, 'run', {run}, 'end', x.end, 'kind', x.kind, 'body', x.body)"
    merged = f"array_sort(concat(transform({base}, {item('false')}), transform({runs}, {item('true')})))"
    ahead = "zip_with(m, transform(slice(m, 2, size(m)), x -> x.start), (x, n) -> named_struct('run', x.run, 'kind', x.kind, 'start', x.start, 'end', x.end, 'body', x.body, 'next', n))"

    def step(t: str, x: str) -> tuple[str, str]:
        free = f"{x}.run and {t}.carry <= {x}.start and coalesce({x}.next >= {x}.end, true)"
        kept = f"array(named_struct('kind', {x}.kind, 'start', {x}.start, 'end', {x}.end, 'body', {x}.body))"
        return f"if({x}.run, {t}.carry, greatest({t}.carry, {x}.end))", f"if({free}, {kept}, cast(array() as {_SPANS}))"

    return f"if(size({base}) = 0 or size({runs}) = 0, {runs}, {once(merged, 'm', once(ahead, 'p', scanned('p', step, _SPAN)))})"


def battery(body: str) -> str:
    """SQL: the tests of one run: struct of encoding, size, chi, runs and serial (z scores), p (that writing looks so
    even, by a logistic form of the normal tail)."""

    def of(name: str, alphabet: str, excess: float) -> str:
        k, text = float(len(alphabet)), f"lower({body})" if name == "hex" else f"translate({body}, '-_', '+/')"
        symbols = ", ".join(f"'{c}'" for c in alphabet)
        squares = f"aggregate(array({symbols}), 0D, (q, c) -> q + pow(f.n - length(replace(f.text, c, '')), 2))"
        codes = f"transform(filter(split(f.text, ''), c -> c <> ''), c -> cast(instr('{alphabet}', c) - 1 as double))"
        high, was = f"c >= {k / 2}D", f"q.last >= {k / 2}D"
        state = "named_struct('last', 0D, 'i', 0D, 'high', 0D, 'turns', 0D, 'sum', 0D, 'square', 0D, 'product', 0D)"
        step = f"""named_struct('last', c, 'i', q.i + 1D, 'high', q.high + if({high}, 1D, 0D), 'turns', q.turns + if(q.i > 0 and ({high}) <> ({was}), 1D, 0D),
            'sum', q.sum + c, 'square', q.square + c * c, 'product', q.product + if(q.i > 0, c * q.last, 0D))"""
        sums = f"aggregate({codes}, {state}, (q, c) -> {step})"
        facts = f"""named_struct('chi', {k}D * {squares} / f.n - f.n, 'both', 2 * g.high * (f.n - g.high), 'turns', g.turns, 'average', g.sum / f.n,
            'spread', g.square / f.n - pow(g.sum / f.n, 2), 'product', g.product)"""
        var = "h.both * (h.both - f.n) / (f.n * f.n * (f.n - 1))"
        z = f"greatest(least(({k - 1}D + {excess}D * f.n - h.chi) / sqrt({2 * (k - 1)}D + {4 * excess}D * f.n), 30D), -30D)"
        told = f"""named_struct('encoding', '{name}', 'size', cast(f.n as int), 'chi', (h.chi - {k - 1}D) / {math.sqrt(2 * (k - 1))}D,
            'runs', if({var} > 0, (h.turns - h.both / f.n) / sqrt({var}), 30D),
            'serial', if(h.spread > 0, (h.product / (f.n - 1) - pow(h.average, 2)) / h.spread * sqrt(f.n), 30D),
            'p', {once(z, "z", "1 / (1 + exp(1.5976D * z + 0.07056D * z * z * z))")})"""
        return once(f"named_struct('text', {text}, 'n', cast(length({body}) as double))", "f", once(sums, "g", once(facts, "h", told)))

    cases = " ".join(f"when {body} rlike '{pattern}' then {of(name, alphabet, excess)}" for name, pattern, alphabet, excess in ENCODINGS[:-1])
    name, _, alphabet, excess = ENCODINGS[-1]
    return f"case {cases} else {of(name, alphabet, excess)} end"


def stratum(t: str) -> str:
    return f"concat({t}.encoding, case when {t}.size < 32 then '-20' when {t}.size < 64 then '-32' else '-64' end)"


def depth(t: str) -> str:
    return f"cast(floor(-10 * log10(greatest({t}.p, {10.0 ** (-BINS / 10)!r}D))) as int)"


def with_spans(docs: DataFrame, text: str = "text", rate: float = 0.01, z: float = 3.5) -> DataFrame:
    """docs with spans: array of (kind, start, end, body), kind an index of KINDS, by start and then kind.

    The first three kinds are the patterns' (an assigned value needs 8 characters or more), "random" is the battery's:
    runs that no base span touches, that none of its tests rejects at `z`, and whose p the false-discovery step passes.
    Null text has no spans, as has empty text. Rows are judged alike wherever they stand; equal rows alike. A column
    spans of docs is replaced; others stay. Without candidates nothing passes; no rows give no rows.
    """
    rest = [c for c in docs.columns if c != "spans"]
    x = docs.select(*rest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    assigned = f"filter({spans_of('_text', ASSIGN, 0, 2)}, x -> length(x.body) >= 8)"
    candidates = f"filter({spans_of('_text', RUN, 3)}, x -> x.body rlike '[0-9]' and x.body rlike '[A-Za-z]')"
    x = x.select(*rest, F.expr(f"concat({assigned}, {spans_of('_text', ACCESS, 1)}, {spans_of('_text', HEX, 2)})").alias("_base"), F.expr(candidates).alias("_runs"))
    x = x.select(*rest, "_base", F.expr(untouched("_base", "_runs")).alias("_free"))
    x = x.select(*rest, "_base", F.expr(f"transform(_free, r -> named_struct('span', r, 'test', {battery('r.body')}))").alias("_tested"))
    tests = x.select(F.explode("_tested.test").alias("t")).selectExpr(f"{stratum('t')} AS stratum", f"{depth('t')} AS depth")
    counted = tests.groupBy("stratum", "depth").agg(F.count("*").alias("n"))
    # Strata times bins: at most 12 * 401 rows, whatever the input.
    by_stratum = Window.partitionBy("stratum")
    sums = counted.select("stratum", "depth", F.sum("n").over(by_stratum.orderBy(F.desc("depth"))).alias("found"), F.sum("n").over(by_stratum).alias("all_n"))
    passed = sums.where(F.pow(F.lit(10.0), -F.col("depth") / 10) * F.col("all_n") <= rate * F.col("found")).groupBy("stratum").agg(F.min("depth").alias("depth"))
    limits = ", ".join(f"'{r['stratum']}', {r['depth']}" for r in passed.collect())
    fair = f"x.test.chi < {z}D and abs(x.test.runs) < {z}D and abs(x.test.serial) < {z}D"
    deep = f"{depth('x.test')} >= coalesce(cast(map({limits}) as map<string,int>)[{stratum('x.test')}], {BINS + 1})"
    spans = f"concat(_base, transform(filter(_tested, x -> {fair} and {deep}), x -> x.span))"
    by_start = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'body', x.body)))"
    return x.select(*rest, F.expr(f"transform({by_start}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'body', x.body))").alias("spans"))


def masked(text: str = "text", spans: str = "spans") -> Column:
    """text with each span's characters replaced by [kind]; of spans that overlap the first one's mark stands. Spans are
    taken in stretches, each over its own piece of text, as a place in a text is found by counting."""
    stretch = f"greatest(16, cast(ceil(sqrt(size({spans}))) as int))"
    mark = "if(x.start >= t.at, array(concat('[', array(" + ", ".join(f"'{k}'" for k in KINDS) + ")[x.kind], ']')), cast(array() as array<string>))"
    before = "substring(r.piece, t.at - s.at + 1, greatest(x.start - t.at, 0))"
    inner = f"aggregate(r.part, named_struct('at', s.at, 'out', cast(array() as array<string>)), (t, x) -> named_struct('at', greatest(t.at, x.end), 'out', concat(t.out, array({before}), {mark})))"
    region = f"named_struct('part', part, 'piece', substring({text}, s.at + 1, greatest(coalesce(array_max(transform(part, x -> x.end)), 0) - s.at, 0)))"
    grown = once(f"slice({spans}, i * {stretch} + 1, {stretch})", "part", once(region, "r", once(inner, "y", "named_struct('at', y.at, 'out', concat(s.out, array(array_join(y.out, ''))))")))
    rest = f"substring({text}, s.at + 1, greatest(length({text}) - s.at, 0))"
    return F.expr(f"""if(size({spans}) = 0, {text}, aggregate(sequence(0, cast(floor(size({spans}) / {stretch}) as int)),
        named_struct('at', 0, 'out', cast(array() as array<string>)), (s, i) -> {grown}, s -> concat(array_join(s.out, ''), {rest})))""")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return x.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES = {"op5_secret_scan": secret_scan}
SQL: dict[str, str] = {}
