"""Byte-level BPE: a backtracking encoder and an offset-table decoder (operator 3).

Encoding. An Aho-Corasick automaton over the vocabulary finds, for every byte of a piece, the longest token that
starts there. The encoder walks the piece, takes the longest match and accepts it if the pair (previous token,
match) is compatible, that is, if merging the two tokens' bytes by rank gives exactly these two tokens again. A
sequence whose neighbours are all compatible is the BPE encoding, so an accepted walk is exact. A match that does not
fit is replaced with the next shorter token of the same start; when there is none, the walk goes back one token. A
position from which no walk can go on is marked and never entered again, and a match is searched for within the length of
the longest token, which keeps the time linear in the piece.

Decoding. All tokens' bytes stand in one buffer; an offset table cuts it. A document's bytes are one numpy gather.

Defined cases: null and empty text give no tokens and the empty text; a special token's string inside a text becomes
that token's id; rows with equal ids or texts are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, release, table

#: Bytes of a generation of a worker's memory, the longest text it remembers, and pairs in the pair table.
CACHE, LONGEST, PAIRS = 40 << 20, 48, 200_000


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    """Results of a function by text, in two generations of bounded bytes: what was not used since the last turn is forgotten at the next.

    Long texts are not remembered, since they hardly return.
    """

    def __init__(self, make):
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, text: str) -> tuple[int, ...]:
        if len(text) > LONGEST:
            return self.make(text)
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        self.held += 100 + getsizeof(text) + getsizeof(ids)  # with its place in the dictionary
        if self.held > CACHE:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[text] = ids
        return ids

    def forget(self) -> None:
        self.old, self.held = {}, 0
        self.clear()


class Vocabulary:
    """Token bytes, merges and the tables derived from them, from the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        data = json.loads(spec)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {k: v for k, v in data["model"]["vocab"].items() if k not in self.special}
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.tokens[i] = word.encode()
        merges = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        #: (left, right) -> (rank, merged)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        #: merged -> its parts and its rank; single bytes have none
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, m = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (rank, m)
            self.parts.setdefault(m, (a, b, rank))
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

        by_bytes = {self.tokens[i]: i for i in vocab.values()}
        self.automaton = ahocorasick.Automaton()
        #: the longest proper prefix of a token that is a token, or -1
        self.shorter = [-1] * size
        for raw, i in by_bytes.items():
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
            for n in range(len(raw) - 1, 0, -1):
                if (j := by_bytes.get(raw[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self.by_bytes = by_bytes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sizes = [len(t) for t in self.tokens]
        self.reach = max(map(len, by_bytes))  # no match is longer
        self.pieces = _Memory(lambda piece: self.piece(piece.encode()))
        self.words = _Memory(self._word)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.special_split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a followed by those of b ends in exactly (a, b); remembered in the pair table."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stays(a, b)
        return known

    def _stays(self, a: int, b: int) -> bool:
        """Undoes the last merges at the border, the later one first.

        A merge across the border wins only if it comes before the merge that formed the inner neighbour; going down
        the right edge of a and the left edge of b in order of rank meets every state the border has had.
        """
        left, right = a, b
        until_left = until_right = float("inf")  # ranks of the merges that consume left and right
        while True:
            if (hit := self.merged.get((left, right))) is not None:
                rank = hit[0]
                # on equal ranks the leftmost occurrence merges first: the border comes after a merge inside a
                if rank < until_left and rank <= until_right:
                    return False
            up, down = self.parts.get(left), self.parts.get(right)
            if up is None and down is None:
                return True
            if down is None or (up is not None and up[2] > down[2]):
                until_left, left = up[2], up[1]
            else:
                until_right, right = down[2], down[0]

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        whole = self.by_bytes.get(raw)
        if whole is not None and self._whole(whole):
            return (whole,)
        text, pairs = raw.decode("latin-1"), self.pairs
        # the walk that never has to go back: leftmost longest matches, all compatible
        out: list[int] = []
        at, last = 0, -1
        for _, (size, i) in self.automaton.iter_long(text):
            if last >= 0:
                fits = pairs.get((last, i))
                if not (self.compatible(last, i) if fits is None else fits):
                    return self._walk(text, out, at, self.shorter[i])
            out.append(i)
            at += size
            last = i
        return tuple(out)

    def _walk(self, text: str, out: list[int], at: int, token: int) -> tuple[int, ...]:
        """Goes on from the accepted tokens out, which end at byte at; token is the next to try there."""
        n, pairs, sizes, shorter, longest, reach = len(text), self.pairs, self.sizes, self.shorter, self.automaton.iter_long, self.reach
        dead = bytearray(n + 1)
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end]:
                    if not out:
                        break
                    fits = pairs.get((out[-1], token))
                    if self.compatible(out[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = next(longest(text[at : at + reach]))[1][1]  # the search costs as much as the string it is given
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary cannot encode this text")
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return tuple(out)

    def _whole(self, i: int) -> bool:
        """Whether the merges really lead to token i from its own bytes."""
        if (parts := self.parts.get(i)) is None:
            return len(self.tokens[i]) == 1
        return self._whole(parts[0]) and self._whole(parts[1]) and self.compatible_before(parts)

    def compatible_before(self, parts: tuple[int, int, int]) -> bool:
        """Whether the two parts still stand side by side when their merge comes."""
        key = (-1 - parts[0], parts[1])
        if (known := self.pairs.get(key)) is None:
            a, b, rank = parts
            hit = self.merged.pop((a, b))
            try:
                known = self._stays(a, b)
            finally:
                self.merged[a, b] = hit
            self.pairs[key] = known
        return known

    def forget(self) -> None:
        """Frees what was remembered; called when a task ends, since an idle worker keeps its memory."""
        self.words.forget()
        self.pieces.forget()

    def _pieces(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a blank and a word. Letters alone are one piece, and so is a single mark after them."""
        if word.isalpha():
            return self.piece((" " + word).encode())
        head, last = word[:-1], word[-1]
        if last in ",.;:!?" and head.isalpha():
            return self.words[head] + self.pieces[last]
        return self._pieces(" " + word)

    def _plain(self, text: str):
        """Ids of a text without special tokens.

        A blank between two words is always the first character of a piece. Where each blank has a word behind it, the
        text falls apart at its blanks, and the worker remembers the ids of each part.
        """
        if _BLANKS.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return chain(self._pieces(first), chain.from_iterable(map(self.words.__getitem__, rest)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        parts, at = [], 0
        for m in self.special_split.finditer(text):
            parts += [self._plain(text[at : m.start()]) if m.start() > at else (), (self.special[m[0]],)]
            at = m.end()
        if at < len(text):
            parts.append(self._plain(text[at:] if at else text))
        return np.fromiter(chain.from_iterable(parts), "<u4")

    def encode_ordinary(self, text: str | None) -> np.ndarray:
        """Ids of a text in which special strings are ordinary text."""
        return np.fromiter(self._plain(text) if text else (), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return self.blob[where].tobytes().decode("utf-8", "replace")


#: A blank without a word behind it.
_BLANKS = re.compile(r" (?:\s|\Z)|\A\s")
_LOADED: dict[int, Vocabulary] = {}


def worker_vocabulary(spec) -> Vocabulary:
    """The vocabulary of a broadcast JSON text, built once in each Python worker."""
    key = spec.id if hasattr(spec, "id") else id(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec.value)
    return _LOADED[key]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The tokenizer file (a few MB, whatever the corpus) for all workers; executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def id_range(path: str) -> tuple[int, dict[str, int]]:
    """How many ids a tokenizer file's vocabulary spans, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    return 1 + max(chain(data["model"]["vocab"].values(), special.values())), special


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) of whole texts."""
    spec = broadcast_vocabulary(docs.sparkSession, path or default_path())

    def run(batches):
        vocab = worker_vocabulary(spec)
        for batch in batches:
            ids = [vocab.encode(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids or [np.zeros(0, "<u4")]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "ids"])
        vocab.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<bigint>")


def decode_documents(coded: DataFrame, path: str | None = None, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from token ids; null ids give the empty text."""
    spec = broadcast_vocabulary(coded.sparkSession, path or default_path())

    def run(batches):
        vocab = worker_vocabulary(spec)
        for batch in batches:
            texts = [vocab.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids")).mapInArrow(run, f"id {kind}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every whole text.

    Encodes and decodes in one pass over the rows, so that no array of ids crosses the border to the JVM.
    """
    spec = broadcast_vocabulary(docs.sparkSession, path or default_path())

    def run(batches):
        vocab = worker_vocabulary(spec)
        for batch in batches:
            n, coded, back = [], [], []
            for t in batch.column(1):
                ids = vocab.encode(t.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocab.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without text, with n_tokens, ids array<int>, and decodes: whether decoding gives the text again."""
    bound_batches(docs.sparkSession)
    spec = broadcast_vocabulary(docs.sparkSession, path or default_path())

    @F.arrow_udf("struct<n_tokens: bigint, ids: array<int>, decodes: boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = worker_vocabulary(spec)
        for batch in batches:
            release()
            sizes, back, flat = [], [], bytearray()
            for t in batch:
                text = t.as_py() or ""
                ids = vocab.encode(text)
                sizes.append(len(ids))
                back.append(vocab.decode(ids) == text)
                flat += ids.tobytes()
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(flat, np.int32)))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists, pa.array(back, pa.bool_())], ["n_tokens", "ids", "decodes"])
        vocab.forget()

    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decodes")]
    return docs.select(*(F.col(f"`{c}`") for c in rest), encode(F.col("text").cast("string")).alias("__coded")).select(*(f"`{c}`" for c in rest), "__coded.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
