"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

The terms of the index are runs of five words (the whole of a shorter text), those that the leak is judged by. An item's
question is cut into entries of at most ENTRY words that overlap by four, so that each of its runs is in one entry. A
term's impact on an entry is its BM25 weight, over the least weight that an entry can have left when a share of 1 -
`overlap` of its runs is missing: hence no entry of which a passage holds `overlap` (0.8) of the runs scores less than 1,
whatever its weights are, and 1 is the threshold of all. Entries stand in tiers by length; for each tier a document is a
row of passages twice as long as the tier's entries and half that apart, so that one of them holds any stretch of words
that long. The whole document is one more passage, the last, so that a question in pieces far apart is found as well: where
a document holds 0.8 of a question's runs, it holds 0.8 of some entry's (if no run stands in several of them). Each passage is a query, and the search returns all
entries above the threshold. A passage whose terms cannot
reach it together has no result and is not searched; its terms are looked up in one pass, and few words of a clean text
are terms at all, however many items there are.

Each item found is verified on the whole document: the shares of the runs of its question and of its answer that stand
there. It is a leak if both reach `overlap`. The answer is the last sentence of an item that has several; an item of one
sentence is question and answer alike.

Words are letters and digits, lower-cased. Null or empty texts and items hold nothing and match nothing. A document gives
one row for each item that it leaks; repeated documents give repeated rows, items of equal text one row each. Rows with a
null doc_id or item_id are treated alike. Empty tables give an empty table. The items are searched in shards of bounded
size: statistics are those of all items, each shard is one broadcast, and with several of them each one's leaks are
written before the next is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_texts, slices, written

ENTRY, SHINGLE = 64, 5
K1, B = 1.2, 0.75
#: Postings in a block with its own maximum.
BLOCK = 32
#: Number of the passage that is a whole text; it sorts after all others.
WHOLE = 1 << 62
#: Bits of the table that tells most runs of words that are no term.
FILTER_BITS = 22
#: Item text that one broadcast holds.
SHARD_BYTES = 16 << 20
#: ASCII letters and digits in lower case, other ASCII bytes as spaces; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of five words; the whole of a shorter text."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


def parts_of(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer; the same for an item of one sentence."""
    sentences = [w for s in re.split(rb"(?<=[.!?])\s+|\n+", text or b"") if (w := words_of(s))]
    if len(sentences) < 2:
        whole = words_of(text)
        return whole, whole
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def entries_of(question: list[bytes]) -> list[list[bytes]]:
    """Stretches of at most ENTRY words, whose runs are together those of the question."""
    last = max(len(question) - SHINGLE + 1, 1)
    return [question[a : a + ENTRY] for a in range(0, last, ENTRY - SHINGLE + 1)] if question else []


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def run_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of each run of n words from the words' codes."""
    total = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for i in range(n if len(total) else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(total)]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)


def terms_of(entry: list[bytes]) -> np.ndarray:
    codes = np.array([word_code(w) for w in entry], np.uint64)
    return run_codes(codes, min(SHINGLE, len(entry)))


class Tier:
    """Postings of entries of like length: for each term, in order of entries, with block maxima."""

    def __init__(self, size: int, rows: list[tuple[int, np.ndarray, np.ndarray]], least: list[float]):
        """rows: (item, terms, impacts) of each entry; least: the share of its weight that impact 1 stands for."""
        self.size, self.of_item, self.least = size, [item for item, _, _ in rows], least
        entry = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for _, t, _ in rows])
        term, impact = np.concatenate([t for _, t, _ in rows]), np.concatenate([x for _, _, x in rows])
        order = np.lexsort((entry, term))
        self.entry, self.impact = entry[order], impact[order]
        self.keys, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.impact, first)
        number = -(-np.diff(self.first) // BLOCK)
        self.block_of = np.concatenate([[0], np.cumsum(number)])
        starts = np.repeat(first, number) + BLOCK * (np.arange(number.sum()) - np.repeat(self.block_of[:-1], number))
        self.block = np.maximum.reduceat(self.impact, starts)

    def _seek(self, term: int, at: int, entry: int) -> int:
        """First posting of the term from `at` on whose entry is that or a later one."""
        return at + int(np.searchsorted(self.entry[at : self.first[term + 1]], entry))

    def _block(self, term: int, at: int) -> int:
        return (at - int(self.first[term])) // BLOCK

    def search(self, terms: list[int], need: float = 1 - 1e-9) -> list[tuple[int, float]]:
        """All entries whose score is the threshold or more: block-max WAND over the terms' postings."""
        found = []
        cursor = [[int(self.entry[self.first[k]]), int(self.first[k]), k] for k in terms]  # entry, posting, term
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, k) in enumerate(cursor):
                bound += self.most[k]
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                return found
            entry = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == entry:
                pivot += 1
            bound, until, ahead = 0.0, None, []
            for _, at, k in cursor[: pivot + 1]:  # the blocks that would hold the pivot's entry
                at = self._seek(k, at, entry)
                ahead.append(at)
                if at < self.first[k + 1]:
                    block = self._block(k, at)
                    bound += self.block[self.block_of[k] + block]
                    edge = int(self.entry[min(int(self.first[k]) + (block + 1) * BLOCK, int(self.first[k + 1])) - 1])
                    until = edge if until is None else min(until, edge)
            if bound < need:  # no entry of these blocks can do
                target = max(entry, until if until is not None else entry) + 1
                if pivot + 1 < len(cursor):
                    target = max(entry + 1, min(target, cursor[pivot + 1][0]))
            else:
                score = sum(float(self.impact[at]) for at, (_, _, k) in zip(ahead, cursor) if at < self.first[k + 1] and self.entry[at] == entry)
                if score >= need:
                    found.append((entry, score))
                target = entry + 1
            moved = [[self._seek(k, at, target), k] for at, (_, _, k) in zip(ahead, cursor)]
            cursor = [[int(self.entry[at]), at, k] for at, k in moved if at < self.first[k + 1]] + cursor[pivot + 1 :]
        return found

    def passages(self, codes: np.ndarray, owner: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Passages that some entry may match, (text, first word, terms), from the runs that may be terms: their codes,
        texts, first words and numbers of words. The first word is WHOLE for the whole text, a text's last passage."""
        place = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        hit = self.keys[place] == codes
        place, owner, at, n = place[hit], owner[hit], at[hit], n[hit]
        number = at // self.size
        before = (number > 0) & (at + n <= (number + 1) * self.size)  # the passage before holds the run as well
        text, number, place = (np.concatenate(x) for x in ((owner, owner[before], owner), (number, number[before] - 1, np.full(len(owner), WHOLE)), (place, place[before], place)))
        if not len(text):
            return
        order = np.lexsort((place, number, text))
        text, number, place = text[order], number[order], place[order]
        new = np.append(True, (text[1:] != text[:-1]) | (number[1:] != number[:-1]))
        once = new | np.append(True, place[1:] != place[:-1])  # each term counts once
        text, number, place, new = text[once], number[once], place[once], new[once]
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(text))
        for i in np.flatnonzero(np.add.reduceat(self.most[place], starts) >= 1 - 1e-6).tolist():
            a = starts[i]
            yield int(text[a]), WHOLE if number[a] == WHOLE else int(number[a]) * self.size, place[a : stops[i]].tolist()


class Index:
    """All entries of some items. `frequency` tells how many entries of all items have a term, `total` how many there are."""

    def __init__(self, items: list[tuple[object, bytes]], frequency: dict[int, int] | None, total: int, average: float, overlap: float):
        self.items = items
        self.parts = [parts_of(t) for _, t in items]
        self.codes = {w: word_code(w) for q, _ in self.parts for w in q}
        made = [(i, len(e), *np.unique(terms_of(e), return_counts=True)) for i, (q, _) in enumerate(self.parts) for e in entries_of(q)]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.lengths = sorted({min(n, SHINGLE) for _, n, _, _ in made})
        if frequency is None:
            keys, counts = np.unique(np.concatenate([t for _, _, t, _ in made] or [np.zeros(0, np.uint64)]), return_counts=True)
        else:
            keys = np.sort(np.array(list(frequency), np.uint64))
            counts = np.array([frequency[int(k)] for k in keys])
        tiers: dict[int, list] = {}
        for i, n, terms, times in made:
            self.filter[terms >> np.uint64(64 - FILTER_BITS)] = True
            df = counts[np.searchsorted(keys, terms)]
            weight = np.log(1 + (total - df + 0.5) / (df + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * n / average))
            missing = int((1 - overlap) * len(terms) + 1e-9)
            whole = weight.sum()
            least = (whole - np.sort(weight)[len(weight) - missing :].sum()) / whole
            tiers.setdefault(max(8, 1 << (n - 1).bit_length()), []).append((i, terms, weight / whole / least, float(least)))
        self.tiers = [Tier(size, [r[:3] for r in rows], [r[3] for r in rows]) for size, rows in sorted(tiers.items())]

    def candidates(self, texts: list[list[bytes]]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text, by item: the best share of an entry's weight, and the first and last word of the passages with it."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        get = self.codes.get
        codes = np.fromiter((c for t in texts for c in (*[get(w, 0) for w in t], 0)), np.uint64, int(sizes.sum()))  # 0: no word of an item
        found = []
        for n in self.lengths:
            runs = run_codes(codes, n)
            sound = self.filter[runs >> np.uint64(64 - FILTER_BITS)]
            for k in range(n):
                sound &= codes[k : k + len(runs)] != 0
            at = np.flatnonzero(sound)
            owner = np.searchsorted(begin, at, side="right") - 1
            found.append((runs[at], owner, at - begin[owner], np.full(len(at), n)))
        if not found:
            return out
        runs, owner, at, n = (np.concatenate(x) for x in zip(*found))
        for tier in self.tiers:
            for t, first, terms in tier.passages(runs, owner, at, n):
                for entry, score in tier.search(terms):
                    item, share = tier.of_item[entry], score * tier.least[entry]
                    if first == WHOLE:  # tells nothing of the place of what a passage has shown
                        best, low, high = out[t].get(item, (0.0, 0, len(texts[t])))
                        out[t][item] = max(best, share), low, high
                        continue
                    last = min(first + 2 * tier.size, len(texts[t]))
                    best, low, high = out[t].get(item, (0.0, first, last))
                    out[t][item] = max(best, share), min(low, first), max(high, last)
        return out

    def shares(self, words: list[bytes], items: list[int]) -> list[tuple[float, float, float]]:
        """Shares of each item's runs that stand in the text: of question, answer and both."""
        there, out = shingles(words), []
        for item in items:
            question, answer = (shingles(p) for p in self.parts[item])
            for n in {len(s) for s in (*question, *answer) if len(s) < SHINGLE}:
                there |= set(zip(*(words[i:] for i in range(n))))
            out.append(tuple(len(p & there) / max(len(p), 1) for p in (question, answer, question | answer)))
        return out


def shards(items: DataFrame, overlap: float, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Index, bool]]:
    """Indexes that together hold all items, and whether there is only one; statistics are those of all items."""
    texts = items.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SHARD_BYTES) or 1

    def make():
        def run(texts: list) -> tuple:
            made = [entries_of(parts_of(t)[0]) for t in texts]
            return [[np.unique(terms_of(e)).view(np.int64) for e in es] for es in made], [[len(e) for e in es] for es in made]

        return run

    if n > 1:
        counted = map_texts(texts.select("text"), "terms array<array<long>>, sizes array<int>", make)
        spread = counted.select(F.explode("sizes").alias("n"))
        by_term, _ = written(counted.select(F.explode(F.flatten("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
        total, average = spread.agg(F.count(F.lit(1)), F.avg("n")).first()
    for i in range(n):
        shard = texts if n == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        rows = [(r[0], bytes(r[1])) for r in shard.collect()]  # SHARD_BYTES of text, by the hash
        if n == 1:
            sizes = [len(e) for _, t in rows for e in entries_of(parts_of(t)[0])]
            yield Index(rows, None, len(sizes), float(np.mean(sizes)) if sizes else 1.0, overlap), True
        else:
            own = map_texts(shard.select("text"), "terms array<array<long>>, sizes array<int>", make).select(F.explode(F.flatten("terms")).alias("term")).distinct()
            joined = by_term.join(own, "term").toArrow()
            frequency = dict(zip(joined.column("term").to_numpy().view(np.uint64).tolist(), joined.column("n").to_pylist()))
            yield Index(rows, frequency, total, average or 1.0, overlap), False


def leaks(docs: DataFrame, items: DataFrame, overlap: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, bm25, overlap, question_overlap, answer_overlap, first_word, last_word) of all leaks; bm25 is the
    best share of an entry's own score."""
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, bm25 double, overlap double, question_overlap double, answer_overlap double, first_word long, last_word long"
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    found = []
    for index, alone in shards(items, overlap, item_col, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        own = map_texts(rows, schema, _finder(shared, overlap))
        if not alone:
            own, _ = written(own, "leaks")
            shared.destroy()
        found.append(own)
    return reduce(DataFrame.unionByName, found)


def _finder(shared, overlap: float):
    def make():
        index = shared.value

        def run(keys, texts):
            out = []
            split = [words_of(t) for t in texts]
            for key, words, items in zip(keys, split, index.candidates(split)):
                order = sorted(items)
                for item, (question, answer, whole) in zip(order, index.shares(words, order) if order else ()):
                    if question >= overlap and answer >= overlap:
                        score, low, high = items[item]
                        out.append((key, index.items[item][0], score, whole, question, answer, low, high))
            return tuple(map(list, zip(*out))) if out else ([],) * 8

        return run

    return make


def without_leaks(docs: DataFrame, items: DataFrame, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns. A document's own text decides, whatever its id."""
    marked = docs
    for index, alone in shards(items, overlap, text_col=text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        leaky = _leaky(_finder(shared, overlap))
        marked = marked.filter(~leaky(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))))
        if not alone:
            marked, _ = written(marked, "unleaked")
            shared.destroy()
    return marked


def _leaky(make):
    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold(__name__)
        run = make()
        for texts in batches:
            bad: set[int] = set()
            for start, end in slices([len(t) for t in texts]):
                bad.update(run(list(range(start, end)), texts.iloc[start:end].tolist())[0])
            yield pd.Series([i in bad for i in range(len(texts))], dtype=bool)

    return leaky
