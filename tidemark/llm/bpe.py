"""Byte-level BPE encoding and decoding.

A text is split at special tokens, then into pieces by the vocabulary's pattern; each piece
is merged by a priority queue of merge ranks over a doubly linked list of symbols, where
entries made stale by an earlier merge are skipped. Decoding concatenates the vocabulary's
byte strings. Words repeat, so each worker keeps the encodings of recent ones in two
generations: when the newer is full it becomes the older, whose entries are forgotten unless
they are asked for again.

Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded each
for itself, a null doc_id is carried through, further columns are left out whatever their
names, and an empty table gives no rows. A text is held whole, with its ids; a piece of any
length is merged in one go.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ._spark import of, spread

#: The pattern of byte-level vocabularies of this kind, with white space as Unicode has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS_KEPT = 500_000  # encodings of a generation: two make about 200 MB
LONGEST_KEPT = 64  # characters of a word that may be kept

_loaded: dict[tuple, "Bpe"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1
    characters for themselves, the rest from code point 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """A vocabulary; as a dict, the packed little-endian 32-bit ids of recent words."""

    kept = WORDS_KEPT

    def __init__(self, source: bytes):
        super().__init__()
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        strings |= {i: t.encode() for t, i in self.specials.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]  # by rank
        self.ranks: list[dict[int, int]] = [{} for _ in self.strings]  # by left id, then right id
        for r, (a, b) in enumerate(pairs):
            self.ranks[vocab[a]][vocab[b]] = r
        self.pieces = regex.compile(PATTERN).findall
        self.spaces = re.compile(rf"[{SPACE}]{{2,}}").finditer
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        return self._keep(word, self.fresh(word) if packed is None else packed)

    def _keep(self, word: str, packed: bytes) -> bytes:
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.older = self.copy()
                self.clear()
            self[word] = packed
        return packed

    def fresh(self, word: str) -> bytes:
        """Packed ids of a word that isn't kept: of its pieces, which may be."""
        pieces = self.pieces(word)
        if len(pieces) == 1:
            return array("I", self.merge(word.encode())).tobytes()
        return b"".join([self.get(p) or self.older.get(p) or self._keep(p, array("I", self.merge(p.encode())).tobytes()) for p in pieces])

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece.

        A heap entry is one number, the rank above the position of a pair's left symbol; it is
        stale if the pair there now has another rank.
        """
        ids, ranks, made = [self.byte_ids[b] for b in data], self.ranks, self.made
        n = len(ids)
        at = [ranks[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        queue = [r << 32 | i for i, r in enumerate(at) if r >= 0]
        heapq.heapify(queue)
        at.append(-1)
        left, right = list(range(-1, n)), list(range(1, n + 1))
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if at[i] != r:
                continue  # stale
            j, new = right[i], made[r]
            ids[i], ids[j], at[j] = new, -1, -1
            right[i] = k = right[j]
            at[i] = -1
            if k < n:
                left[k] = i
                at[i] = r = ranks[new].get(ids[k], -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | i)
            if (h := left[i]) >= 0:
                at[h] = r = ranks[ids[h]].get(new, -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _even(self, text: str) -> bytes:
        """Ids of a text in which no white space follows white space.

        There a piece ends before each space and on both sides of a line feed, so the words
        between are encoded each for itself.
        """
        if "\0" in text:
            return self.fresh(text)
        return b"".join(map(self.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Of a run of white space, all but the last is
        a piece of its own, or all of it at the end of the text."""
        out, at = [], 0
        for m in self.spaces(text):
            end = m.end() - (m.end() < len(text))
            out += [self._even(text[at : m.start()]), self[text[m.start() : end]]]
            at = end
        return b"".join([*out, self._even(text[at:])])

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit numbers."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), array("I", [self.specials[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(_picked(self.strings, ids)).decode("utf-8", "replace")


def _picked(strings: list[bytes], ids: np.ndarray) -> tuple[bytes, ...]:
    return itemgetter(*ids.tolist())(strings) if len(ids) > 1 else tuple(strings[i] for i in ids.tolist())


def ship_vocabulary(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """The vocabulary file (some megabytes) for the executors, and the digest of its content."""
    with open(path, "rb") as f:
        source = f.read()
    return spark.sparkContext.broadcast(source), hashlib.sha256(source).hexdigest()


def vocabulary(shipped: tuple[Broadcast, str], kind: type[Bpe] = Bpe) -> Bpe:
    """In a task: the vocabulary, read once by each Python worker and known by its content."""
    held, digest = shipped
    if (digest, kind) not in _loaded:
        _loaded[digest, kind] = kind(held.value)
    return _loaded[digest, kind]


def _round_trip(shipped: tuple[Broadcast, str], whole: bool):
    def run(batches):
        bpe = vocabulary(shipped)
        names = [b"%d" % i for i in range(len(bpe.strings))]
        for b in batches:
            rows = []
            for text in b.column(1):
                packed = bpe.packed(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4")
                decoded = bpe.decode(ids)
                rows.append((len(ids), packed, decoded) if whole else (len(ids), hashlib.sha256(b",".join(_picked(names, ids))).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, x, y = zip(*rows) if rows else ((), (), ())
            kind = pa.binary() if whole else pa.string()
            titles = ["doc_id", "n_tokens", *(("ids", "decoded") if whole else ("ids_sha256", "decoded_sha256"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, kind), pa.array(y, pa.string())], titles)

    return run


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids packed as little-endian 32-bit numbers, decoded the text they give back."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary_path)
    return spread(of(docs, doc_id="long", text="string")).mapInArrow(_round_trip(shipped, True), "doc_id long, n_tokens long, ids binary, decoded string")


def encode_decode_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the same code, without carrying ids and texts on."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary_path)
    return spread(of(docs, doc_id="long", text="string")).mapInArrow(_round_trip(shipped, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
