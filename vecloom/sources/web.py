"""Bytes by URL (S6), with retries; a failure is a row with its error."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _get(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def fetched(rows: DataFrame, url: str = "url", tries: int = 3, timeout: float = 10.0, get: Callable[[str, float], bytes] = _get) -> DataFrame:
    """(url, content, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b[url]:
                content = error = None
                for k in range(tries):
                    try:
                        content, error = get(u, timeout), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        time.sleep(min(2**k * 0.1, 2) if k + 1 < tries else 0)
                out.append((u, content, error))
            yield pd.DataFrame(out, columns=["url", "content", "error"])

    return rows.select(url).mapInPandas(run, "url string, content binary, error string")
