"""Token ids of a corpus, each shared stretch of text encoded once.

A rolling hash over 16 characters cuts every text where its upper bits are zero, so equal stretches of different
documents fall into equal chunks, which are encoded once, wherever they occur. Ids at the chunks' joins would differ
from those of the whole text; they are repaired from the text around each join: from the last place in the left chunk
to the first place in the right one where the tokenizer's pattern must split whatever surrounds it, the text is encoded
again, and the stretch is widened until encoding it with the next stretches on both sides gives exactly the same ids.
The ids of a text are those of its chunks with the ends next to joins replaced.

Chunks travel as 128-bit hashes, ids as two bytes each. The pass that finds the joins sends no text; the pass that fills
the dictionary sends each chunk once per batch of rows, so a chunk that a third of all rows hold makes no hot task.

Defined results: null and empty texts give an empty list (0 tokens); strings of special tokens are ordinary text; rows
with equal id and text count as one in `token_ids` and keep their number in `token_counts`; texts are never cut off.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one of these queries.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters: the hash's window, the least and the greatest chunk; a cut is set at one of 2^CUT_BITS places.
WINDOW, LEAST, MOST, CUT_BITS = 16, 256, 16_384, 10
#: Characters that are hashed at a time.
SPAN = 1 << 20


@lru_cache(4)
def encoding(vocab: str = VOCAB) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks whose vocabulary splits text by PATTERN, as both public ones of the kind do."""
    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values(), default=0) >= 1 << 16:
        raise ValueError("ids are packed in 16 bits, and this vocabulary needs more")
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _hashes(points: np.ndarray) -> np.ndarray:
    """Of each place, a hash of the WINDOW characters that end there: the sum of g(c) << distance, by doubling."""
    h, span = points * np.uint32(0x9E3779B1), 1
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(texts: list[str]) -> list[list[int]]:
    """The chunk ends of each text, its length included."""
    out: list[list[int]] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SPAN):
            size += len(texts[to])
            to += 1
        group = texts[at:to]
        if size > LEAST:
            points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            marks = np.flatnonzero(_hashes(points) >> np.uint32(32 - CUT_BITS) == 0) + 1
        else:
            marks = np.zeros(0, int)
        base = 0
        for t in group:
            n, last, ends = len(t), 0, []
            if n > LEAST:
                own = marks[np.searchsorted(marks, base + LEAST) : np.searchsorted(marks, base + n)] - base
                for m in own.tolist():
                    while m - last > MOST:
                        last += MOST
                        ends.append(last)
                    if m - last >= LEAST and n - m >= WINDOW:
                        ends.append(m)
                        last = m
            while n - last > MOST:
                last += MOST
                ends.append(last)
            out.append([*ends, n])
            base += n
        at = to
    return out


@lru_cache(1 << 16)
def _kind(ch: str) -> str:
    c = unicodedata.category(ch)[0]
    return c if c in "LN" else "O" if c in "PSM" else "S" if ch in " \n" else "?"


def _splits(a: str, b: str) -> bool:
    """Whether the pattern splits between these characters in any text."""
    x, y = _kind(a), _kind(b)
    if x not in "LNO" or y == "?":
        return False
    return y == "S" or x != y and not (y == "L" and a == "'")


def _before(t: str, i: int, least: int) -> int:
    """The last sure split in t[least + 1 : i], or least."""
    i -= 1
    while i > least and not _splits(t[i - 1], t[i]):
        i -= 1
    return max(i, least)


def _after(t: str, i: int, most: int) -> int:
    """The first sure split in t[i + 1 : most], or most."""
    i += 1
    while i < most and not _splits(t[i - 1], t[i]):
        i += 1
    return min(i, most)


def joins(t: str, ends: list[int], enc: tiktoken.Encoding) -> list[tuple[int, int, list[int]]]:
    """Of each chunk: ids to leave out at its start (-1: the chunk lies in a repaired stretch) and end, ids to put before it.

    A last entry beyond the chunks has only ids to put before it: those of a stretch that reaches the text's end.
    """
    n, f = len(ends), enc.encode_ordinary
    if n == 1:
        return [(0, 0, [])]
    starts = [0, *ends[:-1]]
    core = [[starts[k] if not k else _after(t, starts[k], ends[k]), ends[k] if k == n - 1 else _before(t, ends[k], starts[k])] for k in range(n)]
    agreed = False
    while not agreed:
        agreed = True
        kept = [k for k in range(n) if core[k][0] < core[k][1]]
        gaps = []  # (chunk it stands before, its ids)
        for left, right in zip([None, *kept], [*kept, None], strict=True):
            a, b = (0 if left is None else core[left][1]), (len(t) if right is None else core[right][0])
            if a == b:
                continue
            ids = f(t[a:b])
            a2 = a if left is None else _before(t, a, core[left][0])
            b2 = b if right is None else _after(t, b, core[right][1])
            if f(t[a2:b2]) != f(t[a2:a]) + ids + f(t[b:b2]):
                agreed = False
                if left is not None:
                    core[left][1] = a2
                if right is not None:
                    core[right][0] = b2
                break
            gaps.append((n if right is None else right, ids))
    out = [(-1, 0, [])] * n + [(-1, 0, [])]
    before = dict(gaps)
    for k in kept:
        out[k] = (len(f(t[starts[k] : core[k][0]])), len(f(t[core[k][1] : ends[k]])), before.get(k, []))
    if n in before:
        out[n] = (-1, 0, before[n])
    return [x for x in out[:n]] + [out[n]] * (n in before)


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u2").tobytes()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, counts: bool = False) -> DataFrame:
    """`h, ids` (or `h, n`) of each different chunk."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, seen = b["text"].tolist(), {}
            for t, ends in zip(texts, cuts(texts), strict=True):
                last = 0
                for e in ends:
                    raw = t[last:e].encode()
                    seen.setdefault(xxhash.xxh3_128_digest(raw), raw)
                    last = e
            yield pd.DataFrame({"h": list(seen), "raw": list(seen.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, seen = encoding(vocab).encode_ordinary, set()
        for b in batches:
            rows = []
            for h, raw in zip(b["h"], b["raw"], strict=True):
                if h not in seen:
                    seen.add(h)
                    ids = f(raw.decode())
                    rows.append((h, len(ids) if counts else _packed(ids)))
            yield pd.DataFrame(rows, columns=["h", "n" if counts else "ids"])

    texts = _source(docs, id_col, text_col).where("text <> ''").select("text")
    return texts.mapInPandas(split, "h binary, raw binary").repartition("h").mapInPandas(encode, "h binary, n int" if counts else "h binary, ids binary")


def chunk_refs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """`doc_id, dh, idx, h, head, tail, put` of each chunk of each text that isn't empty; dh: the text's 128-bit hash."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, digest = encoding(vocab), xxhash.xxh3_128_digest
        for b in batches:
            texts, rows = b["text"].tolist(), []
            for i, t, ends in zip(b["doc_id"].tolist(), texts, cuts(texts), strict=True):
                last, dh = 0, digest(t.encode())
                for k, (head, tail, put) in enumerate(joins(t, ends, enc)):
                    h = None
                    if head >= 0:
                        h = dh if len(ends) == 1 else digest(t[last : ends[k]].encode())
                    if k < len(ends):
                        last = ends[k]
                    if head >= 0 or put or k == 0:
                        rows.append((i, dh, k, h, max(head, 0), tail, _packed(put)))
            yield pd.DataFrame(rows, columns=["doc_id", "dh", "idx", "h", "head", "tail", "put"])

    return _source(docs, id_col, text_col).where("text <> ''").mapInPandas(run, f"doc_id {id_type}, dh binary, idx int, h binary, head int, tail int, put binary")


def _with_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs with their chunk's columns. Chunk-less refs (stretches at a text's end) bypass the join."""
    rest = refs.where("h is null")
    for c in chunks.columns[1:]:
        rest = rest.withColumn(c, F.lit(None).cast(chunks.schema[c].dataType))
    return refs.where("h is not null").join(chunks, "h").select(*rest.columns).unionByName(rest)


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """`doc_id, ids`, one row per different (doc_id, text)."""
    refs = chunk_refs(docs, id_col, text_col, vocab)
    own = F.expr("case when ids is null then put else concat(put, substring(ids, 2 * head + 1, length(ids) - 2 * (head + tail))) end")
    parts = _with_chunks(refs, dictionary(docs, id_col, text_col, vocab)).select("doc_id", "dh", "idx", own.alias("part"))

    @F.pandas_udf("array<int>")
    def assembled(rows: pd.Series) -> pd.Series:
        def one(parts: np.ndarray) -> np.ndarray:
            by = {p["idx"]: p["part"] for p in parts}
            return np.frombuffer(b"".join(by[k] for k in sorted(by)), "<u2").astype(np.int32)

        return rows.map(one)

    found = parts.groupBy("doc_id", "dh").agg(F.collect_list(F.struct("idx", "part")).alias("parts")).select("doc_id", assembled("parts").alias("ids"))
    empty = _source(docs, id_col, text_col).where("text is null or text = ''").select("doc_id").distinct().withColumn("ids", F.expr("cast(array() as array<int>)"))
    return found.unionByName(empty)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """`doc_id, dh, n_tokens, copies`: the size of each different (doc_id, text) and how many rows have it; dh is null for texts without tokens."""
    refs = chunk_refs(docs, id_col, text_col, vocab)
    own = F.coalesce(F.col("n") - F.col("head") - F.col("tail"), F.lit(0)) + (F.length("put") / 2).cast("int")
    sizes = _with_chunks(refs, dictionary(docs, id_col, text_col, vocab, counts=True)).select("doc_id", "dh", "idx", own.alias("own"))
    found = sizes.groupBy("doc_id", "dh").agg(F.sum("own").alias("total"), F.count(F.when(F.col("idx") == 0, 1)).alias("copies"))
    found = found.select("doc_id", "dh", (F.col("total") / F.col("copies")).cast("bigint").alias("n_tokens"), "copies")
    empty = _source(docs, id_col, text_col).where("text is null or text = ''").groupBy("doc_id").agg(F.count("*").alias("copies"))
    return found.unionByName(empty.select("doc_id", F.lit(None).cast("binary").alias("dh"), F.lit(0).cast("bigint").alias("n_tokens"), "copies"))
