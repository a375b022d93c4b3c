"""Operator 2: BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's root holds the lowest rank and, among equals, the leftmost pair. A merge changes at most two
neighbouring pairs, so each step costs O(log n) and a word of n symbols O(n log n), however long it is.

Words with other characters than ASCII are normalised and cut by the tokenizers library itself, so that both follow one
version of Unicode; its merges are not used.

Defined cases: null text counts as empty and gives no ids; a text's length is not bounded (words, not texts, are
held in the caches, which hold a bounded number of them); repeated rows give repeated results; an empty table gives an
empty result; columns other than the text are passed through by select and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = 1 << 60  # the rank of a pair that never merges
FEW = 64  # words for which a table is not worth its making
GROUP = 1 << 21  # characters of texts whose words are merged together


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(spare)})
    return table


def merge(ids: list[int], ranks: dict[int, int]) -> list[int]:
    """All merges of a word, each the leftmost of the lowest rank, through a minimum tree over adjacent pairs.

    ranks: left id * 65536 + right id -> rank * 65536 + merged id, so a node holds the rank and what comes of it. The
    root is the next merge; going down to the left child wherever it equals the root finds its leftmost place. A merge
    changes three leaves, and a change stops climbing where a node keeps its value."""
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    low = [NONE] * size + [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])] + [NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = low[2 * i], low[2 * i + 1]
        low[i] = a if a <= b else b
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while (root := low[1]) != NONE:
        i = 1
        while i < size:
            i *= 2
            if low[i] != root:
                i += 1
        i -= size
        j = after[i]
        ids[i], ids[j] = root & 0xFFFF, -1
        k, h = after[j], before[i]
        after[i] = k
        if k >= 0:
            before[k] = i
            changes = [(i, get(ids[i] << 16 | ids[k], NONE)), (j, NONE)]
        else:
            changes = [(i, NONE)]
        if h >= 0:
            changes.append((h, get(ids[h] << 16 | ids[i], NONE)))
        for at, rank in changes:
            at += size
            low[at] = rank
            while at > 1:
                at >>= 1
                a, b = low[2 * at], low[2 * at + 1]
                if b < a:
                    a = b
                if low[at] == a:
                    break
                low[at] = a
    return [i for i in ids if i >= 0]


class Forest:
    """The same merges for many short words at once: their trees are columns of one table, and a step is a step of each.

    Row v of `low` holds node v of every word's tree; the ranks of pairs are looked up in a sorted table."""

    SIZES = (8, 16, 32)  # pairs of a word

    def __init__(self, ranks: dict[int, int]):
        self.pairs = np.array(sorted(ranks) or [-1], np.int64)
        self.values = np.array([ranks.get(p, NONE) for p in self.pairs.tolist()], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of pairs; a negative id is no symbol."""
        pair = np.where((left < 0) | (right < 0), np.int64(-2), left << 16 | right)
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.values[at], NONE)

    def merge(self, words: list[list[int]], size: int) -> np.ndarray:
        """words of 2 to size + 1 ids -> (word, place) table of ids, -1 where there is none."""
        w, none = len(words), size + 1
        ids = np.full((size + 2, w), -1, np.int64)  # the last row stands for no neighbour
        lengths = np.fromiter(map(len, words), np.int64, w)
        flat = np.fromiter((i for x in words for i in x), np.int64, lengths.sum())
        column = np.repeat(np.arange(w), lengths)
        ids[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = flat
        after = np.repeat(np.arange(1, size + 3)[:, None], w, 1)
        before = np.repeat(np.arange(-1, size + 1)[:, None], w, 1)
        after[(after >= lengths) | (after > size)] = none
        before[0] = none
        low = np.full((2 * size, w), NONE)
        low[size:] = self.look_up(ids[:size], ids[1 : size + 1])
        for v in range(size - 1, 0, -1):
            np.minimum(low[2 * v], low[2 * v + 1], out=low[v])
        live = np.flatnonzero(low[1] != NONE)
        while len(live):
            root = low[1, live]
            v = np.ones(len(live), np.int64)
            for _ in range(size.bit_length() - 1):  # down, to the left wherever it holds the root's value
                v *= 2
                v += low[v, live] != root
            i = v - size
            j = after[i, live]
            k, h = after[j, live], before[i, live]
            ids[i, live], ids[j, live] = root & 0xFFFF, -1
            after[i, live], before[k, live] = k, i
            ids[none] = -1
            changed = [(i, live, self.look_up(ids[i, live], ids[k, live]))]
            some = j < size
            changed.append((j[some], live[some], np.full(some.sum(), NONE)))
            some = h != none
            changed.append((h[some], live[some], self.look_up(ids[h[some], live[some]], ids[i[some], live[some]])))
            for at, word, rank in changed:
                at = at + size
                low[at, word] = rank
                for _ in range(size.bit_length() - 1):
                    at = at >> 1
                    low[at, word] = np.minimum(low[2 * at, word], low[2 * at + 1, word])
            live = live[low[1, live] != NONE]
        return ids[: size + 1].T


class BpeCodec:
    """A vocabulary file of the tokenizers library (byte letters, word-end suffix, no decoder)."""

    def __init__(self, path: str, chunks: int = 60_000, words: int = 120_000):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        if len(self.vocab) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        end = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 16 | self.vocab[b]] = rank << 16 | self.vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.marks = tuple({t[:2] for t in self.added})
        # a byte's id inside a word and at its end; symbols that the vocabulary lacks are dropped, as without unk
        letters = _byte_letters()
        self.inside = [self.vocab.get(letters[b], -1) for b in range(256)]
        self.final = [self.vocab.get(letters[b] + end, -1) for b in range(256)]
        self.bytes = {c: b for b, c in letters.items()}
        self.forest = Forest(self.ranks)
        # letters whose lower case is one letter and that nothing composes with, as the library has it: no need to ask
        self.plain = {c for c in map(chr, range(0xC0, 0x180)) if len(low := self.normalise(c)) == 1 and low == c.lower() and self.normalise(f"{c}{c}") == low * 2 and len(self.cut(f"a{low}b")) == 1}
        piece = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = re.compile(piece.replace(r"\p{L}", "A-Za-z" + "".join(sorted(self.plain))).replace(r"\p{N}", "0-9"))
        self.simple = re.compile("[!-~" + "".join(sorted(self.plain)) + "]*").fullmatch
        # two generations each, turned over between batches: what was used since the last turn outlives the next one
        self.most, self.chunks, self.old_chunks, self.known, self.old_known = (chunks, words), {}, {}, {}, {}

    def _units(self, chunk: str) -> list[str | int]:
        """Words and added tokens of a stretch without white space: added tokens come first, then normalising."""
        parts = (chunk,)
        for m in self.marks:
            if m in chunk:
                parts = self.split_added.split(chunk)
        out: list[str | int] = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif self.simple(part):
                out += self.words.findall(part.lower())
            else:
                out += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.cut(self.normalise(part))]
        return out

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens: short ones together, by the number of their pairs, long ones one by one."""
        out: list[list[int]] = []
        groups: dict[int, list[int]] = {n: [] for n in Forest.SIZES}
        for at, word in enumerate(words):
            raw = word.encode()
            ids = [self.inside[b] for b in raw[:-1]]
            ids.append(self.final[raw[-1]])
            if -1 in ids:
                ids = [i for i in ids if i >= 0]
            out.append(ids)
            n = len(ids) - 1
            if n > Forest.SIZES[-1]:
                out[at] = merge(ids, self.ranks)
            elif n > 0:
                groups[8 if n <= 8 else 16 if n <= 16 else 32].append(at)
        for size, places in groups.items():
            if len(places) < FEW:
                for at in places:
                    out[at] = merge(out[at], self.ranks)
                continue
            for i in range(0, len(places), 20_000):
                some = places[i : i + 20_000]
                table = self.forest.merge([out[at] for at in some], size)
                kept = table >= 0
                flat, ends = table[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
                for at, a, b in zip(some, [0, *ends], ends):
                    out[at] = flat[a:b]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Works out all of chunks that are not known yet: (number of ids, ids as decimals, decoded text)."""
        if len(self.chunks) >= self.most[0]:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.known) >= self.most[1]:
            self.old_known, self.known = self.known, {}
        mine, old, known, old_known = self.chunks, self.old_chunks, self.known, self.old_known
        new = chunks - mine.keys()
        again = new & old.keys()
        for c in again:
            mine[c] = old[c]
        new -= again
        units = {c: self._units(c) for c in new}
        words = {u for us in units.values() for u in us if u.__class__ is str} - known.keys()
        again = words & old_known.keys()
        for u in again:
            known[u] = old_known[u]
        unknown = list(words - again)
        for u, ids in zip(unknown, self.merge_words(unknown)):
            known[u] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        added = {i: (1, str(i), self.names[i]) for i in self.added.values()}
        for c, us in units.items():
            if len(us) == 1 and us[0].__class__ is str:
                mine[c] = known[us[0]]
            else:
                got = [known[u] if u.__class__ is str else added[u] for u in us]
                mine[c] = sum(g[0] for g in got), " ".join([g[1] for g in got if g[0]]), " ".join([g[2] for g in got if g[0]])

    @staticmethod
    def split(text: str | None) -> list[str]:
        """Stretches without white space."""
        if not text:
            return []
        # str.split also cuts at 1C-1F, which are no white space to the tokenizer
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in regex.split(r"[^\S\x1c-\x1f]+", text) if c]
        return text.split()

    def round_trips(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the ids as decimals, and the text decoded from them: what its stretches give,
        joined by spaces. Texts are taken in groups of about GROUP characters, so that words are merged together."""
        group, size = [], 0
        for text in texts:
            group.append(self.split(text))
            size += len(text or "")
            if size >= GROUP:
                yield from self._joined(group)
                group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self.learn(set().union(*group))
        get = self.chunks.__getitem__
        for chunks in group:
            pieces = list(map(get, chunks))
            counts = [p[0] for p in pieces]
            if not all(counts):
                pieces = [p for p in pieces if p[0]]
            yield sum(counts), " ".join([p[1] for p in pieces]), " ".join([p[2] for p in pieces])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, said, _ in self.round_trips([text]) for i in said.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False) where the file names no decoder: tokens and spaces."""
        return " ".join(map(self.names.__getitem__, ids))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def encode(text: Column | str, path: str) -> Column:
    """array<int> of ids of a text column."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([list(map(int, said.split())) for _, said, _ in c.round_trips(texts)])

    return run(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of a column of ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode(r if r is not None else ()) for r in rows])

    return run(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """Encode, decode what came out, and digest both in one Arrow pass, so that ids need not travel."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(path)
        rows = [(n, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()) for n, said, shown in c.round_trips(texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("doc_id", round_trip("text", path).alias("b")).select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")
