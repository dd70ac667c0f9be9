"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

A run of token characters, or what the patterns leave of one, is compared under two first-order models, one of random
strings and one of ordinary words and identifiers. Both are learned from labelled samples: what the patterns
found and seeded random strings on one side, the corpus' own words and repeated characters on the other. A run is a
secret if the mean log-likelihood ratio per character and the sum both pass their thresholds.
"""

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c

# Fixed patterns and lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "markov")
LEAST_RUN = 20
MEAN_BITS, SUM_BITS = 1.0, 30.0
SAMPLES = 20_000
TOKEN = np.zeros(256, bool)
TOKEN[list((string.ascii_letters + string.digits + "+/_=-").encode())] = True
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
CODE = np.zeros(256, np.int64)
CODE[list((string.ascii_letters + string.digits + "+/_=-").encode())] = np.arange(1, 68)
STATES = 68


def patterns(text: str, hex_spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(a, b, "hex") for a, b in hex_spans]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def long_runs(data: np.ndarray, at: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of at least so many bytes, and where each text's runs start."""
    start, stop, _ = c.words(data, at, inside)
    keep = stop - start >= least
    start, stop = start[keep], stop[keep]
    return start, stop, np.searchsorted(start, at)


def scan(batch: pa.RecordBatch, model: np.ndarray | None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of every text, in code points, in order."""
    data, at = c.buffer(batch.column("text"))
    hex_a, hex_b, hex_at = long_runs(data, at, HEX, LEAST["hex"])
    run_a, run_b, run_at = long_runs(data, at, TOKEN, LEAST_RUN)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
    base, rest_a, rest_b, rest_at = [], [], [], [0]
    texts = batch.column("text")
    for k in range(batch.num_rows):
        hexes, runs = slice(hex_at[k], hex_at[k + 1]), slice(run_at[k], run_at[k + 1])
        first = points[at[k]]
        found = patterns(texts[k].as_py(), list(zip((points[hex_a[hexes]] - first).tolist(), (points[hex_b[hexes]] - first).tolist(), strict=True)))
        base.append(found)
        if model is not None:
            spans = list(zip((points[run_a[runs]] - first).tolist(), (points[run_b[runs]] - first).tolist(), strict=True))
            for start, stop, byte in beside(spans, found, run_a[runs].tolist()):
                # Inside a run a code point is a byte.
                rest_a.append(byte)
                rest_b.append(byte + stop - start)
        rest_at.append(len(rest_a))
    if model is None:
        return base
    a, b = np.array(rest_a, np.int64), np.array(rest_b, np.int64)
    score = ratios(data, a, b, model)
    random = (score[:, 0] >= MEAN_BITS) & (score[:, 1] >= SUM_BITS)
    for k, found in enumerate(base):
        mine = np.arange(rest_at[k], rest_at[k + 1])
        mine = mine[random[mine]]
        if len(mine):
            first = points[at[k]]
            found += zip((points[a[mine]] - first).tolist(), (points[b[mine]] - first).tolist(), ["markov"] * len(mine), strict=True)
            found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return base


def beside(runs: list[tuple[int, int]], spans: list[tuple[int, int, str]], places: list[int]) -> Iterator[tuple[int, int, int]]:
    """What the spans, ordered by start, leave of the runs, if long enough: start, end and place in the buffer."""
    j, end = 0, 0  # next span, and how far those before it reach
    for (start, stop), place in zip(runs, places, strict=True):
        free = start
        while True:
            while j < len(spans) and spans[j][0] <= max(free, end):
                end = max(end, spans[j][1])
                j += 1
            free = max(free, end)
            to = min(stop, spans[j][0]) if j < len(spans) else stop
            if to - free >= LEAST_RUN:
                yield free, to, place + free - start
            if to >= stop or free >= stop:
                break
            free = to


def ratios(data: np.ndarray, start: np.ndarray, stop: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Mean and sum of the log-likelihood ratio, in bits, of each run; signs at both ends don't count."""
    out = np.zeros((len(start), 2))
    for k, (a, b) in enumerate(zip(start, stop, strict=True)):
        text = data[a:b].tobytes().strip(b"=-_/+")
        if len(text) >= LEAST_RUN:
            code = CODE[np.frombuffer(text, np.uint8)]
            bits = model[np.r_[0, code[:-1]], code].sum()
            out[k] = bits / len(text), bits
    return out


def transitions(samples: list[str]) -> np.ndarray:
    """Smoothed first-order transition probabilities; state 0 is the start."""
    count = np.full((STATES, STATES), 0.5)
    for text in samples:
        code = CODE[np.frombuffer(text.encode(), np.uint8)]
        code = code[code > 0]
        np.add.at(count, (np.r_[0, code[:-1]], code), 1)
    count[:, 0] = 0
    return count / count.sum(axis=1, keepdims=True)


def samples_of(batch: pa.RecordBatch):
    """Labelled samples of a batch: values of the patterns (1), other words (0)."""
    for text, spans in zip(batch.column("text").to_pylist(), scan(batch, None), strict=True):
        random = [re.split(r"[:= \"']", text[a:b])[-1] for a, b, _ in spans]
        rest, end = [], 0
        for a, b, _ in spans:
            rest.append(text[end:a])
            end = max(end, b)
        ordinary = re.findall(r"[A-Za-z0-9+/_=-]{4,}", " ".join([*rest, text[end:]]))
        values = [x for x in random if x] + ordinary
        yield {"value": values, "random": [True] * (len(values) - len(ordinary)) + [False] * len(ordinary)}


def seeded(n: int) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    rng = np.random.default_rng(11)
    kinds = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.digits + "abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    return ["".join(rng.choice(list(kinds[k % len(kinds)]), rng.integers(20, 64))) for k in range(n)]


def learn(spark: SparkSession, docs: DataFrame, samples: int = SAMPLES) -> np.ndarray:
    """Bits for every transition, from at most ``samples`` distinct strings of either label, picked by hash.

    The strings come from about ``samples`` / 10 whole texts, picked by a hash of the text.
    """
    c.bounded(spark)
    texts = docs.where("text IS NOT NULL").select("text")
    share = samples / 10 / max(1, texts.count())
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    found = c.map_batches(texts, samples_of, "value string, random boolean").distinct().withColumn("lot", F.xxhash64("value"))
    one, other = (found.where(f"random = {x}").orderBy("lot").limit(samples).select("value").toPandas()["value"].tolist() for x in ("true", "false"))
    same = [x * 30 for x in string.ascii_letters + string.digits for _ in range(1 + len(other) // 200)]
    return np.log2(np.maximum(1e-12, transitions(one + seeded(6_000)))) - np.log2(np.maximum(1e-12, transitions(other + same)))


def find_secrets(spark: SparkSession, docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans, found.

    ``found`` is the list of spans, ``spans`` its text. Null text counts as empty; other columns are ignored, repeated
    rows stay repeated. A span of the models never covers what a pattern covers; it may end where one begins.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        spans = scan(batch, shared.value)
        joined = [[f"{kind}:{a}:{b}" for a, b, kind in s] for s in spans]
        base = [",".join(x for x, s in zip(j, sp, strict=True) if s[2] != "markov") for j, sp in zip(joined, spans, strict=True)]
        yield {
            "doc_id": batch.column("doc_id"),
            **{f"n_{k}": [sum(x[2] == k for x in s) for s in spans] for k in KINDS},
            "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
            "spans": [",".join(j) for j in joined],
            "found": [[{"kind": k, "start": a, "stop": b} for a, b, k in s] for s in spans],
        }

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, found array<struct<kind: string, start: int, stop: int>>"
    return c.map_batches(c.documents(docs), run, schema)


def redact(spark: SparkSession, docs: DataFrame, model: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """The rows of docs, with their columns; every span of a text is replaced by the mark, a null text stays."""
    c.bounded(spark)
    shared = spark.sparkContext.broadcast(model)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            batch = pa.RecordBatch.from_pydict({"text": pa.array(texts.fillna(""), pa.string())})
            out = [cover(t, s, mark) for part in c.pieces(batch) if part.num_rows for t, s in zip(part.column("text").to_pylist(), scan(part, shared.value), strict=True)]
            yield pd.Series(out, index=texts.index, dtype=object).where(texts.notna(), None)
            c.release()

    return docs.withColumn("text", F.pandas_udf(clean, "string")("text"))


def cover(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, end = [], 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
