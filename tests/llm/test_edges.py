"""Brute force, edge cases and bounds of time of the operators that SQL cannot express."""

import math
import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from vecloom.llm import jaccard, packing, pages, secrets, sentencepieces, shared, tokens_file, toxicity

public = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"


def brute_spans(texts, rate=0.01, z=3.5):
    """Spans of the secret scan by Python's patterns and plain sums."""
    base, tested, counts = {}, {}, {}

    def test_of(body):
        name, _, alphabet, excess = next(e for e in secrets.ENCODINGS if re.match(e[1], body))
        codes = [alphabet.index(c) for c in (body.lower() if name == "hex" else body.replace("-", "+").replace("_", "/"))]
        n, k = len(codes), len(alphabet)
        chi = k * sum(codes.count(c) ** 2 for c in range(k)) / n - n
        high = [c >= k / 2 for c in codes]
        both = 2 * sum(high) * (n - sum(high))
        var = both * (both - n) / (n * n * (n - 1))
        turns = sum(x != y for x, y in zip(high, high[1:]))  # noqa: B905
        runs = (turns - both / n) / math.sqrt(var) if var > 0 else 30.0
        mean = sum(codes) / n
        spread = sum(c * c for c in codes) / n - mean * mean
        serial = (sum(x * y for x, y in zip(codes, codes[1:])) / (n - 1) - mean * mean) / spread * math.sqrt(n) if spread > 0 else 30.0  # noqa: B905
        u = max(min((k - 1 + excess * n - chi) / math.sqrt(2 * (k - 1) + 4 * excess * n), 30), -30)
        p = 1 / (1 + math.exp(1.5976 * u + 0.07056 * u**3))
        fair = (chi - (k - 1)) / math.sqrt(2 * (k - 1)) < z and abs(runs) < z and abs(serial) < z
        return f"{name}{'-20' if n < 32 else '-32' if n < 64 else '-64'}", math.floor(-10 * math.log10(max(p, 1e-40))), fair

    for d, t in texts.items():
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        base[d] = found
        tested[d] = []
        for m in re.finditer(secrets.RUN, t or ""):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b in found):
                tested[d].append((m.start(), 3, m.end(), *test_of(m[0])))
                counts.setdefault(tested[d][-1][3], []).append(tested[d][-1][4])
    limit = {}
    for s, depths in counts.items():
        good = [x for x in depths if 10 ** (-x / 10) * len(depths) <= rate * sum(y >= x for y in depths)]
        limit[s] = min(good, default=math.inf)
    return {d: sorted(base[d] + [x[:3] for x in tested[d] if x[5] and x[4] >= limit[x[3]]]) for d in texts}


def test_secret_spans_against_brute_force(spark):
    rng = random.Random(8)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    signs = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "abc": "abcabcabd1"}
    for i in range(300):
        bits = ["".join(rng.choice(signs[rng.choice([*signs])]) if j == 0 else rng.choice(a) for j in range(rng.choice([10, 24, 33, 70]))) for a in rng.choices([*signs.values()], k=4)]
        glue = rng.choice([" ", " é ", ".", "=", ": token=", " API_KEY = '", "AKIA", " 𝄞password\"  :  \"", "\n"])
        texts[10_000 + i] = glue.join(bits)
    texts |= {20_000: None, 20_001: "", 20_002: "token=\nsecret: 1234567 Passwd=12345678 AKIAAKIAAKIAAKIAx"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    want = brute_spans(texts)
    assert sum(s[1] == 3 for x in want.values() for s in x) > 50
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.with_spans(df).collect()}
    assert got == want


def test_many_secrets_in_one_text(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(10_000)]
    start = time.monotonic()
    out = secrets.with_spans(spark.createDataFrame([(0, " ".join(keys))], "doc_id int, text string"))
    r = out.select(secrets.masked().alias("t"), "spans").first()
    assert r["t"] == " ".join(["[hex]"] * 10_000) and [s["start"] for s in r["spans"]] == [*range(0, 41 * 10_000, 41)]
    assert time.monotonic() - start < 60


def test_best_run_against_brute_force():
    rng = random.Random(6)
    weights = {"w:": 0.5, "w:p": 1.0, "w:div": 0.3, "w:li": 0.2, "w:a": 0.1, "w:a+": 0.1, "t:p": -0.7, "t:div": -1.5, "t:li": -1.1, "t:b": -0.1, "t:a": -0.9}
    for _ in range(300):
        parts = []
        for i in range(rng.randint(1, 12)):
            tag = rng.choice(["p", "div", "li", "b", "a", "p", "div"])
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag}>w{i} x</{tag}>", " ".join(f"w{i}y{k}" for k in range(rng.randint(1, 6)))]))
        page = "".join(parts)
        found = pages.read(page)
        scores = [weights.get(k, 0.5) * len(t.split()) if k[0] == "w" else weights.get(k, -0.3) for k, t, _ in found]
        best, span = 0.0, (0, 0)
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                if sum(scores[a:b]) > best + 1e-9:
                    best, span = sum(scores[a:b]), (a, b)
        got, wanted = pages.main_text(page, weights), {b for k, t, b in found[slice(*span)] if k[0] == "w" and t.strip()}
        texts = [" ".join("".join(t for k, t, b in found if b == x and k[0] == "w").split()) for x in sorted(wanted)]
        if got != "\n\n".join(t for t in texts if t):  # another run of the same sum
            blocks = got.split("\n\n")
            own = [i for i, (k, t, b) in enumerate(found) if k[0] == "w" and t.strip() and any(" ".join(t.split()) in x for x in blocks)]
            assert own and max(sum(scores[a : max(own) + 1]) for a in range(max(own) + 1)) == pytest.approx(best)


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "text", "<p><div>" * 200_000 + "x", "<a title='x>y " * 200_001, '<a title="x>y\'s ' * 200_000, "</div>" * 400_000, "<!-- x" * 300_000, "<script>" * 200_000], ids=["nested", "paragraphs", "quote", "quotes", "closing", "comments", "scripts"])
def test_pages_take_time_in_proportion(page):
    start = time.monotonic()
    pages.main_text(page, {})
    assert time.monotonic() - start < 20


def test_scripts_do_not_hide_what_follows():
    weights = pages.fit(pages.labelled_pages())
    body = "the words of this block go on for a while and then they end"
    page = f"<body><script>var a = \"<b title='\";</script><article><p>{body} it's</p></article><style>x{{content:'<p'}}</style></body>"
    assert pages.main_text(page, weights) == f"{body} it's"


def test_pages_edges(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>one two three"), (None, None, "<p>one two three")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "one two three", 13)] * 2 + [(1, "", 0)] * 2


def test_near_copies_without_doc_id_keep_their_links(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:199], "other"]
    far = [*words[:170], *(f"v{i}" for i in range(30))]
    rows = [(5, " ".join(words)), (None, " ".join(near)), (9, " ".join([*near[:198], "third", "other"])), (7, " ".join(far)), (None, "alone"), (None, None)]
    got = jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by == {(5, 197): 5, (None, 197): 5, (9, 197): 5, (7, 197): 7, (None, 1): None, (None, 0): None}
    chain = [(1, " ".join(words)), (None, " ".join(words[7:] + [f"x{i}" for i in range(7)])), (3, " ".join(words[14:] + [f"x{i}" for i in range(14)]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_groups(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == {1: 1, None: 1, 3: 1}


def test_schedule_beyond_64_bit_products():
    total, weight = np.array([1 << 45, 1 << 45, 3, 1 << 40]), np.array([1.0, 1.0, 0.0, 5.0])
    plan = packing.Schedule(total, weight, 4096)
    rates = [int(x) for x in plan.rate[0][0]]
    rng = random.Random(1)
    for _ in range(200):
        q = rng.randrange(4)
        j = rng.randrange(int(total[q]))
        want = j
        for s in range(4):
            if s != q:  # tokens i of s that fall due before (2j+1)/r, or then if s comes first
                due = Fraction((2 * j + 1) * rates[s], rates[q])
                ahead = math.ceil((due - 1) / 2) if s > q else math.floor((due - 1) / 2) + 1
                want += min(int(total[s]), max(ahead, 0))
        assert plan.rank(np.array([q]), np.array([j]))[0] == want


def test_schedule_is_round_robin_step_by_step():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(1, 9)
        total, weight = [rng.randint(0, 60) for _ in range(n)], [rng.choice([0, 1, 2, 5]) for _ in range(n)]
        plan = packing.Schedule(np.array(total), np.array(weight), 16)
        rates = [int(x) for x in plan.rate[0][0]]
        given, order = [0] * n, []
        while len(order) < sum(total):  # the queue whose next token is due first has the largest deficit
            q = min((q for q in range(n) if given[q] < total[q]), key=lambda q: (Fraction(2 * given[q] + 1, 2 * rates[q]), q))
            order.append((q, given[q]))
            given[q] += 1
        ranks = plan.rank(np.array([q for q, _ in order], np.int64), np.array([j for _, j in order], np.int64))
        assert ranks.tolist() == [*range(len(order))]


def test_packing_of_many_sources(spark):
    rows = [(i, "one two three four five six seven", f"host{i % 1000}") for i in range(3000)] + [(3000, None, None), (3000, "", "host1"), (None, "x", "host1")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), public.path("word_bpe_49k.json"), 2, length=512, targets={"host7": 1.0, "host8": 1.0}).collect()
    first = [r for r in got if r["sequence_id"] == 0]
    assert {r["source"] for r in sorted(first, key=lambda r: r["offset"])[:4]} <= {"host7", "host8", "", *[f"host{i}" for i in range(1000)]}
    by = {s: sum(r["length"] for r in first if r["source"] == s) for s in ("host7", "host8")}
    assert by["host7"] == by["host8"] == sum(r["length"] for r in got if r["source"] == "host7")  # all of both, at once
    assert sum(r["length"] for r in got) == 3000 * 8 + 1 + 1 + 2


def test_token_file_format(spark, tmp_path):
    rows = [(i // 3, f"some words {i} " * 200) for i in range(900)] + [(None, "x"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens_file.write_tokens(df, f"file://{tmp_path}/t", public.path("word_bpe_49k.json"), 1, partitions=2)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    assert files
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids = next(c for p, c in columns.items() if p.startswith("ids."))
        assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index
        for name in ("doc_id", "start_in_part", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_column_index
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in tokens_file.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert [d for d, _, _ in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))  # noqa: B905
    none = spark.createDataFrame([], "doc_id long, text string")
    tokens_file.write_tokens(none, f"file://{tmp_path}/e", public.path("word_bpe_49k.json"), 1)
    assert tokens_file.read_tokens(spark, f"file://{tmp_path}/e").count() == 0
    picked = tokens_file.read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 5").select("n_tokens")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_toxicity_of_real_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 1"))
    assert model.names == ["poor", "toxic"] and len(model.chain) == 2
    out = toxicity.score(docs.join(labels, "doc_id").where("doc_id % 4 = 1"), model).collect()
    assert sum(r["is_toxic"] == bool(r["toxic"]) for r in out) / len(out) >= 0.9


def test_chain_against_a_plain_one():
    rng = np.random.default_rng(1)
    x = (rng.random((80, 6)) < 0.4).astype(float)
    y = np.stack([x[:, 0], np.maximum(x[:, 0] * x[:, 1], x[:, 2])], axis=1)
    y[3, 0] = np.nan
    bits = lambda m, *dense: toxicity.Bits(*np.nonzero(m), m.shape, np.column_stack(dense) if dense else None)
    uses = [np.array([0, 1, 4]), np.arange(6)]
    some = x * np.isin(np.arange(6), uses[0])
    chain = toxicity.fit_chain(bits(x), y, uses)
    first = toxicity.fit_linear(bits(some), y[:, 0])
    seen = np.zeros(80)
    for k in range(5):
        rest = np.arange(80) % 5 != k
        seen[~rest] = toxicity.predict(toxicity.fit_linear(bits(some[rest]), y[rest, 0]), bits(some[~rest]))
    second = toxicity.fit_linear(bits(x, seen), y[:, 1])
    assert np.allclose(chain[0], first) and np.allclose(chain[1], second)
    p = 1 / (1 + np.exp(-(some @ first[:6] + first[6])))
    q = 1 / (1 + np.exp(-(x @ second[:6] + p * second[6] + second[7])))
    assert np.allclose(toxicity.run_chain(chain, bits(x), uses), np.stack([p, q], axis=1))


def test_toxicity_edges(spark):
    rows = [(i, f"bad{i % 7} word" if i % 2 else "good word", i % 2, None) for i in range(200)] * 3 + [(999, "w" * 60 + " bad1", 1, 1), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality"), sample=150)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) and {r["is_toxic"] for r in out if r["text"] == "good word"} == {False}
    none = df.limit(0)
    assert toxicity.score(none, toxicity.train(none, none)).count() == 0
    assert "=" + "w" * 60 in toxicity.features("w" * 60)


def test_pieces_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepieces.encode(none, public.path("piece_bpe_32k.model")).count() == 0


def test_shared_folder_can_be_removed(spark):
    old = spark.conf.get("spark.vecloom.sharedDir", None)
    spark.conf.unset("spark.vecloom.sharedDir")
    df = shared.written(spark.range(5), "numbers")
    folder = shared.shared_dir(spark)
    assert df.count() == 5
    shared.remove(spark)
    from pathlib import Path

    assert not Path(folder.removeprefix("file://")).exists()
    spark.conf.unset("spark.vecloom.sharedDir") if old is None else spark.conf.set("spark.vecloom.sharedDir", old)
