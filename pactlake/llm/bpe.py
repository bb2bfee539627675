"""BPE encoding and decoding with forced-boundary splitting.

A merge joins two neighbours into a token of the vocabulary, so two bytes that stand side by side
in no token of the vocabulary can never end up in one token: between them there is a certain cut.
Words are cut there, the fragments are encoded independently (each distinct one once), and their ids
are concatenated. Encoding is one Arrow pass over whole texts without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table, text_of

#: Entries of each half of a worker's memory of words and of fragments: when the new half is full it
#: becomes the old one, from which words that come again are taken over. Longer words aren't kept.
MEMO_WORDS, MEMO_LENGTH = 200_000, 32
#: Symbols from which a fragment is merged by a heap.
LONG = 64
#: Control characters that str.split() takes for white space and the pre-tokenizer doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: From this code point on, letters, numbers and cases differ between Unicode versions: words with such
#: characters are normalized and split by the library itself.
STABLE_BELOW = "\u0250"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder from the text of a tokenizer file: BPE with an end-of-word suffix."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        self.library = Tokenizer.from_str(source)
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.letters = {a + b: k for (a, b), k in self.ranks.items() if len(a) == len(b) == 1}  # of two single symbols
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        bare = (t.removesuffix(self.end) for t in self.vocab)
        self.inside = {t[k : k + 2] for t in bare for k in range(len(t) - 1)}
        # a fragment at a word's end is kept under its text and a space
        self.fragments: dict[str, list[int]] = {}
        self.old_fragments: dict[str, list[int]] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.old_memo: dict[str, tuple[int, str, str]] = {}
        self.normals: dict[str, str] = {}

    def cut(self, word: str) -> list[str]:
        """Fragments of a word of byte symbols, cut where a pair occurs inside no token."""
        inside = self.inside
        if inside.issuperset([word[k : k + 2] for k in range(len(word) - 1)]):
            return [word]
        out, start = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                out.append(word[start:k])
                start = k
        return [*out, word[start:]]

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of a fragment: the neighbours of lowest rank are merged first, the leftmost among equals."""
        parts = list(fragment)
        if last:
            parts[-1] += self.end
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank, none = self.ranks.get, len(self.ranks)
        two = self.letters.get
        ranks = [two(fragment[k : k + 2], none) for k in range(len(parts) - 1)]
        if last and ranks:
            ranks[-1] = rank((parts[-2], parts[-1]), none)
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return [self.vocab[p] for p in parts]

    def merge_long(self, parts: list[str]) -> list[int]:
        """The same by a heap over a linked list, so that long fragments without a cut stay near linear."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        ranks = self.ranks
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k] if parts[k] == a else -1
            if n < 0 or parts[n] != b:
                continue
            parts[k], parts[n] = a + b, ""
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, given as text."""
        mapped = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
        out: list[int] = []
        pieces = self.cut(mapped)
        last = len(pieces) - 1
        for k, piece in enumerate(pieces):
            key = piece if k < last else piece + " "
            ids = self.fragments.get(key)
            if ids is None:
                ids = self.old_fragments.get(key) or self.merge(piece, k == last)
                if len(piece) <= MEMO_LENGTH:
                    if len(self.fragments) >= MEMO_WORDS:
                        self.fragments, self.old_fragments = {}, self.fragments
                    self.fragments[key] = ids
            out += ids
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a normalized chunk without white space: usually a word with its punctuation."""
        if chunk.isascii() or max(chunk) < STABLE_BELOW:
            if chunk.isalpha():
                return self.word_ids(chunk)
            if chunk[-1] in ".,:;!?" and chunk[:-1].isalpha():
                return self.word_ids(chunk[:-1]) + self.word_ids(chunk[-1])
            words = self.words.findall(chunk)
        else:
            words = [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return [i for w in words for i in self.word_ids(w)]

    def chunks(self, text: str) -> list[str]:
        """Normalized chunks of a text without special tokens: what white space parts, in lower case. No
        character of white space composes with another, so chunks can be normalized one by one."""
        wide = not text.isascii() and max(text) >= STABLE_BELOW
        text = text if wide else text.lower()
        found = [c for c in _SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split()
        return [self.normal(c) for c in found] if wide else found

    def normal(self, chunk: str) -> str:
        if chunk.isascii() or max(chunk) < STABLE_BELOW:
            return chunk.lower()
        known = self.normals.get(chunk)
        if known is None:
            known = self.library.normalizer.normalize_str(chunk)
            if len(chunk) <= MEMO_LENGTH:
                if len(self.normals) >= MEMO_WORDS:
                    self.normals.clear()
                self.normals[chunk] = known
        return known

    def summed(self, chunk: str) -> tuple[int, str, str]:
        """Of a chunk: how many ids, the ids in decimal, and what they decode to."""
        found = self.memo.get(chunk)
        if found is None:
            found = self.old_memo.get(chunk)
            if found is None:
                ids = self.chunk_ids(chunk)
                found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(chunk) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo, self.old_memo = {}, self.memo
                self.memo[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """summed() of every chunk of the whole text, special tokens among them."""
        if self.at_special is None or "<|" not in text:
            known = self.memo.get
            return [known(c) or self.summed(c) for c in self.chunks(text)]
        out = []
        for k, piece in enumerate(self.at_special.split(text)):
            out += [(1, str(self.special[piece]), piece)] if k % 2 else [self.summed(c) for c in self.chunks(piece)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text or "") if ids for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as without a decoder; ids out of the vocabulary give nothing."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_built: dict[int, ForcedBoundaryBPE] = {}


def _encoder(source: str) -> ForcedBoundaryBPE:
    """One encoder, with its memory of words, for all tasks of a Python worker."""
    key = hash(source)
    if key not in _built:
        _built.clear()
        _built[key] = ForcedBoundaryBPE(source)
    return _built[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, tokenizer: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if None), n_tokens and ids of every whole text.

    tokenizer: path of a tokenizer file on the driver; its text, of fixed size, is broadcast. A null
    text is encoded as the empty one: no ids; bytes that aren't UTF-8 count as U+FFFD. Repeated rows stay
    repeated. A kept column of the name of a result column gives way to it.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def start():
        bpe = _encoder(shared.value)

        def one(x):
            ids = bpe.encode(text_of(x))
            return len(ids), ids

        return one

    out = T.StructType().add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return map_texts(df, text, [c for c in df.columns if c != text] if keep is None else keep, out, start)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """df with the column `decoded`: the text of the ids, null for null."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        bpe = _encoder(shared.value)
        return column.map(lambda x: None if x is None else bpe.decode(list(x)))

    return df.withColumn("decoded", text_of(ids))


def digests(df: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: `keep`, n_tokens, ids_sha256, decoded_sha256; the ids themselves needn't leave the worker."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def start():
        bpe = _encoder(shared.value)

        def one(x):
            parts = [p for p in bpe.parts(text_of(x)) if p[0]]
            ids, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
            return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    out = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_texts(df, text, list(keep), out, start)


def op1_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
