"""Secret scans: base patterns, and a token-efficiency test for random strings.

Base kinds are three patterns, each matched leftmost and without overlaps over
the whole text.  Added spans (kind ``token``) are runs of key-like characters
that a byte-pair vocabulary encodes badly: a random string yields few characters
a token, words and paths many.  Known digests (pure hexadecimal), UUIDs and
numbers are excluded, as is what a base span covers: the rest of its run is still
tested.  A run that is encoded well as a whole is cut at "/" and "=", and then at
"_" and "-": neighbouring parts that are encoded badly are tested together.

Null and empty texts have no spans.  Rows that repeat a doc_id are scanned as
rows of their own; an empty table gives no rows.  Offsets are code points.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import narrow, small_batches

#: Base patterns (fixed values), in the order in which equal starts are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "token")

#: A candidate of the efficiency test: this many key-like characters and more.
MIN_RUN = 20
#: Characters a token, at most, of what counts as random.
MAX_RATIO = 2.2

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 and more: a shorter one can't hold a longer
_hex = re.compile(r"[0-9a-f]{24,}")
_run = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_digest = re.compile(rf"[0-9a-f]+|[0-9A-F]+|{_UUID}|[0-9_=+/-]+")
_inside = re.compile(rf"(?<![A-Za-z0-9])(?:[0-9a-f]{{{MIN_RUN},}}|[0-9A-F]{{{MIN_RUN},}}|{_UUID})(?![A-Za-z0-9])")
_cuts = re.compile(r"[^/=]+"), re.compile(r"[^/=_-]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then in the order of kinds."""
    found = [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _access.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def known(run: str) -> bool:
    """A digest, UUID or number."""
    return bool(_digest.fullmatch(run))


def _uncovered(start: int, end: int, spans: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """The parts of start..end outside the spans from place ``at`` on, which neither overlap nor touch."""
    while at < len(spans) and spans[at][0] < end:
        if start < spans[at][0]:
            yield start, spans[at][0]
        start = spans[at][1]
        at += 1
    if start < end:
        yield start, end


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _badly_encoded(text: str, start: int, end: int, tokens, max_ratio: float, cuts: tuple = _cuts) -> Iterator[tuple[int, int, str]]:
    part = text[start:end]
    if len(part) < MIN_RUN or known(part):
        return
    if len(part) <= max_ratio * tokens(part):
        yield start, end, "token"
    elif cuts:
        pieces = [(start + m.start(), start + m.end()) for m in cuts[0].finditer(part)]
        for bad, group in itertools.groupby(pieces, lambda p: p[1] - p[0] <= max_ratio * tokens(text[p[0] : p[1]])):
            group = list(group)
            for a, b in [(group[0][0], group[-1][1])] if bad else group:
                yield from _badly_encoded(text, a, b, tokens, max_ratio, cuts[1:])


def random_spans(text: str, base: list[tuple[int, int, str]], tokens, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Spans of kind ``token``: runs, or parts of them, with few characters a token, outside the base spans.

    ``tokens`` gives the number of tokens of a string.
    """
    found, at = [], 0
    runs = list(_run.finditer(text))
    taken = _united([(s, e) for s, e, _ in base] + [k.span() for m in runs for k in _inside.finditer(text, *m.span())])
    for m in runs:
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        for start, end in _uncovered(*m.span(), taken, at):
            start += 0 if start == m.start() else len(text[start:end]) - len(text[start:end].lstrip("/="))
            found += _badly_encoded(text, start, end, tokens, max_ratio)
    return found


def token_counter(ranks_path: str):
    """A function from a string to its number of tokens under a tiktoken rank file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coder.encode_ordinary(s))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans) of every row; one pass without a shuffle."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                if count is None and _run.search(text):
                    count = token_counter(ranks_path)
                added = random_spans(text, base, count, max_ratio) if count else []
                kinds = [kind for _, _, kind in base]
                spans = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                out.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    schema = "doc_id string, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    plain = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("string"), "text")  # a null stays a null in pandas
    return plain.mapInPandas(rows, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame, ranks_path: str, text_col: str = "text", mask: str = "[SECRET]", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``; other columns as they are.  Null texts stay null."""
    small_batches(docs.sparkSession)

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = token_counter(ranks_path)
        for batch in batches:
            yield pd.Series([_masked(t, count, mask, max_ratio) for t in batch], dtype=object)

    masked = F.pandas_udf(column, T.StringType(), F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(text_col, masked(docs[text_col].cast("string")))


def _masked(text, count, mask: str, max_ratio: float):
    if not isinstance(text, str):
        return None
    base = base_spans(text)
    out, at = [], 0
    for start, end, _ in sorted(base + random_spans(text, base, count, max_ratio)):
        if end > at:
            out += [text[at : max(start, at)], mask if start >= at else ""]
            at = end
    return "".join(out) + text[at:]
