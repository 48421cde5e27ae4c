"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed against each automaton:
a phrase is the longest match that starts where the one before has ended, at least one symbol. The language with the
fewest phrases, normalised by the bits that a phrase costs there (log2 of the sample's length) and the text's length,
wins. Letters are folded to lower case, with their marks, and runs of anything else to one separator, which words share;
symbols are the bytes of that, so that no letter of any script is merged with another. Texts are parsed whole, side by
side; one of over BLOCK symbols in blocks of that size, at whose ends a phrase ends, too.

The sample: at most `sample_chars` symbols a language, and an equal part of `all_chars` if that is less, but `least_chars`
at least, so that every labelled language is learned; from at most `sample_rows` distinct texts, the first in the order
of a hash of the text, each with at most `row_chars` characters of it. Null and empty texts, and texts without a letter,
are `und` with score 0. Rows with null language teach nothing; without any labelled text everything is `und`. Ties go to
the first language in alphabetical order. Repeated rows have equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, hold, map_texts, slices, small_batches

BLOCK = 4096
#: The result for texts without a letter.
UNKNOWN = "und"
#: The bit of letters() that tells marks from letters.
MARK = np.uint32(1 << 31)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 if it is no letter or mark of one; marks have the bit MARK."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(x := chr(c))[0]
        if kind == "L":
            table[c] = ord(x.lower()[0])
        elif kind == "M":
            table[c] = c | int(MARK)
    return table


def folded(text: bytes) -> np.ndarray | None:
    """Bytes of the lower-case letters; each run of anything else, and either end, is one space. None without a letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    low = letters()[points]
    if not ((low != 0) & (low < MARK)).any():
        return None
    low = np.concatenate([[0], low & ~MARK, [0]]).astype("<u4")
    low = low[(low != 0) | (np.concatenate([[1], low[:-1]]) != 0)]
    low[low == 0] = 32
    return np.frombuffer(low.tobytes().decode("utf-32-le").encode(), np.uint8)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return go


class Parser:
    """Phrase counts against each language's automaton. Each has a table as wide as its sample has symbols, and one for
    all others: entry state * width + symbol is twice the next row, plus one if a phrase had to end before the symbol."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.codes, self.tables, self.bits = [], [], []
        for k in self.languages:
            text = np.frombuffer(samples[k], np.uint8)
            known = np.unique(text)
            width = len(known) + 1
            code = np.zeros(256, np.uint8)  # 0: a symbol that the sample lacks, a phrase of its own
            code[known] = np.arange(1, width)
            go = automaton(code[text].tolist())
            alone = len(go)  # the state after such a symbol
            table = np.full((alone + 1, width), -1, np.int32)
            for state, out in enumerate(go):
                table[state, list(out)] = list(out.values())
            ends = table < 0
            table = np.where(ends, np.where(table[0] < 0, alone, table[0]), table)
            ends[0] = False  # where a block begins, no phrase ends
            self.codes.append(code)
            self.tables.append((table * width << 1 | ends).ravel())
            self.bits.append(float(np.log2(len(text) + 2)))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language) phrase counts."""
        sizes = np.array([len(t) for t in texts])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        total = int(blocks.sum())
        grid = np.zeros(total * BLOCK, np.uint8)
        at = np.concatenate([[0], np.cumsum(blocks)])[:-1] * BLOCK
        for t, a in zip(texts, at):
            grid[a : a + len(t)] = t
        length = np.full(total, BLOCK)
        length[np.cumsum(blocks)[blocks > 0] - 1] -= (blocks * BLOCK - sizes)[blocks > 0]
        order = np.argsort(-length, kind="stable")  # blocks that go on stand first
        grid = np.ascontiguousarray(grid.reshape(total, BLOCK)[order].T)
        alive = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        out = np.zeros((len(texts), len(self.languages)))
        for k, (code, table) in enumerate(zip(self.codes, self.tables)):
            own = code[grid]
            count, state = np.zeros(total, np.int32), np.zeros(total, np.int32)
            for step in range(BLOCK):
                n = alive[step]
                if not n:
                    break
                entry = table[state[:n] + own[step, :n]]
                count[:n] += entry & 1
                state[:n] = entry >> 1
            out[:, k] = np.bincount(owner[order], count + 1, len(texts))
        return out

    def judge(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and cross-parsing entropy (bits a symbol) of each text."""
        symbols = [folded(t) for t in texts]
        some = [i for i, s in enumerate(symbols) if self.languages and s is not None]
        names, score, entropy = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if some:
            length = np.array([len(symbols[i]) for i in some])
            bits = self.phrases([symbols[i] for i in some]) * np.array(self.bits)
            best = bits.argmin(1)
            lead = np.exp2(-np.clip(bits - bits.min(1, keepdims=True), 0, 60) / 4)
            for row, i in enumerate(some):
                names[i] = self.languages[best[row]]
                score[i] = float(1 / lead[row].sum())
                entropy[i] = float(bits[row, best[row]] / length[row])
        return names, score, entropy


def samples(docs: DataFrame, train: Column, sample_chars: int = 40_000, all_chars: int = 240_000, least_chars: int = 2000, sample_rows: int = 100, row_chars: int = 2000, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Folded sample text of each language."""
    rows = docs.filter(train & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col, F.lit(11)).alias("h"), F.left(F.col(text_col), F.lit(row_chars)).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    # the least hashes: about twice the rows that are needed
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(int(2 * sample_rows / max(n, 1) * 2**64), 2**64 - 1) - 2**63)))
    few = rows.filter(F.col("h") <= limits[F.col("lang")]).dropDuplicates(["lang", "h"]).orderBy("h", "lang").limit(4 * sample_rows * len(sizes)).collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in few:
        if len(own := out.setdefault(r["lang"], [])) < sample_rows and (text := folded(r["text"].encode())) is not None:
            own.append(text)
    most = min(sample_chars, max(all_chars // len(sizes), least_chars))
    return {k: np.concatenate(v)[:most].tobytes() for k, v in out.items() if v}


_parsers: dict[int, tuple[dict, Parser]] = {}
cached(__name__, _parsers.clear)


def parser(model: dict[str, bytes]) -> Parser:
    """The parser of a model; a worker builds it once."""
    key = hash(tuple(sorted(model.items())))
    if key not in _parsers or _parsers[key][0] != model:
        _parsers.clear()
        _parsers[key] = model, Parser(model)
    return _parsers[key][1]


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = parser(shared.value)
        return lambda keys, texts: (keys, *own.judge([t or b"" for t in texts]))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col), F.col(text_col).cast("binary")), f"`{id_col}` {kind}, lang_pred string, score double, entropy double", make)


def with_languages(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", into: str = "identified") -> DataFrame:
    """All columns of docs and a struct (lang_pred, score, entropy), without a join: for filters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, entropy double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold(__name__)
        own = parser(shared.value)
        for texts in batches:
            found: list[list] = [[], [], []]
            for start, end in slices([len(t) for t in texts]):
                for column, more in zip(found, own.judge(texts.iloc[start:end].tolist())):
                    column += more
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "entropy"), found)))

    return docs.withColumn(into, judged(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))))
