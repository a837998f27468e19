"""BPE encoding and decoding (9) by per-prefix dynamic programming.

Byte-pair merging gives each prefix of a pre-token one encoding, and the last
token of that encoding fixes the rest: it is the one vocabulary token that ends
at the prefix, and that merging keeps apart from the last token of the shorter
prefix. For every prefix the candidates come from a suffix automaton of the
vocabulary (its links list the tokens that end at a byte), the pair test picks
the right one, and following the stored last tokens back from the end gives the
ids, equal to those of the merge procedure.

Pre-tokens are independent: those new to a task are taken together in order of
length, one byte of all of them at a time in numpy, and
their encodings go to a bounded cache that lasts as long as the task. Added tokens (such as an end-of-text marker) found in a text are
split off first, as the tokenizers library does by default.

Rows: null text counts as empty (no tokens); an empty table gives an empty
result; texts are whole and of any length. A pre-token of length n takes O(n)
steps. The tokenizer file must be readable at ``path`` on every worker.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import released

# The pre-token pattern of byte-level vocabularies; {L} letters, {N} numbers, {S} white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
# The classes inside Latin-1, for the faster standard matcher.
LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": "\t-\r \x85\xa0"}
UNICODE = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
CACHE_ENTRIES = 200_000
PAIR_BITS = 18  # of the number of pairs whose test is kept
LEARN_CELLS = 1_000_000  # pre-tokens learned together, times the bytes of the longest
FEW = 128  # fewer pre-tokens are taken one by one
SLICE_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 is itself, the others follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class SuffixAutomaton:
    """Lists the tokens that end at a byte: Aho-Corasick over the vocabulary.

    ``step`` holds the next node of each node and byte, ``top`` the longest token that ends at a node (-1: none) and
    ``below`` for each token the next shorter one that ends where it ends.
    """

    def __init__(self, ids: dict[bytes, int]):
        import numpy as np

        tree: dict[int, int] = {}  # node << 8 | byte -> child in the trie
        own, depth = [-1], [0]
        for word, token in ids.items():
            node = 0
            for byte in word:
                child = tree.get(node << 8 | byte)
                if child is None:
                    child = tree[node << 8 | byte] = len(own)
                    own.append(-1)
                    depth.append(depth[node] + 1)
                node = child
            own[node] = token
        edges, children = np.fromiter(tree.keys(), "i8", len(tree)), np.fromiter(tree.values(), "i4", len(tree))
        own, level = np.array(own, "i4"), np.array(depth, "i4")[children]
        self.step = np.zeros((len(own), 256), "i4")
        self.top = own.copy()
        self.below = np.full(max(ids.values(), default=0) + 1, -1, "i4")
        link = np.zeros(len(own), "i4")  # the node of the longest proper suffix
        for d in range(1, max(depth) + 1):
            at = np.flatnonzero(level == d)
            parent, byte, node = edges[at] >> 8, edges[at] & 255, children[at]
            link[node] = self.step[link[parent], byte] if d > 1 else 0
            if d == 1:
                self.step[0, byte] = node
            else:
                self.step[parent, byte] = node
            self.step[node] = self.step[link[node]]  # its own children follow with the next level
            longer = self.top[link[node]]
            self.below[own[node][own[node] >= 0]] = longer[own[node] >= 0]
            self.top[node] = np.where(own[node] >= 0, own[node], longer)


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import numpy as np
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type"), spec["normalizer"]) != ("BPE", "ByteLevel", None) or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        raw = lambda s: bytes(alphabet[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in added}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in added.items()}
        # id -> the pair it is merged from; pair -> (rank of the merge, id)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = {i: -1 for i in self.bytes_of}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        for rank, pair in enumerate(model["merges"]):
            left, right = (raw(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.merge[a, b] = (rank, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
        self.suffixes = SuffixAutomaton(self.ids)
        self.added = added
        self.split_added = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.latin = re.compile(PRE_TOKEN.format(**LATIN))
        self.any = regex.compile(PRE_TOKEN.format(**UNICODE))
        self.beyond = re.compile("[^\x00-\xff]")
        self.packed: dict[str, bytes] = {}  # pre-token -> its ids as little-endian int32
        # the pair test by a hash of the pair
        self.pairs, self.pair_stays = np.full(1 << PAIR_BITS, -1, "i8"), np.zeros(1 << PAIR_BITS, bool)
        self.sizes = np.zeros(max(self.size_of, default=0) + 1, "i8")
        self.sizes[list(self.size_of)] = list(self.size_of.values())

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a + b leaves exactly the tokens a, b.

        Undo the merges of both tokens from the latest one on (of equal ranks
        the left one was made first). The two tokens that face each other at
        the cut would have merged if the rank of their pair comes before the
        undone merge that ended their time, or equals it and that merge lies on
        the right.
        """
        limit = (1 << 60, 0)  # (rank, side) of the merge that ended the time both face each other
        while True:
            met = self.merge.get((a, b))
            if met is not None and (met[0], 0) < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = (ra, 0), self.parts[a][1]
            else:
                limit, b = (rb, 1), self.parts[b][0]

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Put the encodings of new pre-tokens into the cache, those of like length together."""
        if len(self.packed) >= CACHE_ENTRIES:
            self.packed.clear()
        group: list[tuple[bytes, str]] = []
        for piece, name in sorted(((name.encode(), name) for name in pre_tokens), key=lambda x: len(x[0])):
            if group and (len(piece) + 1) * (len(group) + 1) > LEARN_CELLS:
                self._learn(group)
                group = []
            group.append((piece, name))
        if group:
            self._learn(group)

    def _learn_one(self, piece: bytes, name: str, known: dict[tuple[int, int], bool]) -> None:
        """One pre-token by itself: long ones, and those of short texts."""
        step, top, below, size_of = self.suffixes.step, self.suffixes.top, self.suffixes.below, self.size_of
        node, last = 0, [-1]
        for end, byte in enumerate(piece, 1):
            node = step.item(node, byte)
            token = top.item(node)
            while (size := size_of[token]) < end:
                pair = (last[end - size], token)
                stays = known.get(pair)
                if stays is None:
                    if len(known) >= 1 << PAIR_BITS:
                        known.clear()
                    stays = known[pair] = self.stays(*pair)
                if stays:
                    break
                token = below.item(token)
            last.append(token)
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= size_of[last[end]]
        self.packed[name] = struct.pack(f"<{len(ids)}i", *ids[::-1])

    def _learn(self, pieces: list[tuple[bytes, str]]) -> None:
        """The same for ``pieces`` in rising order of length, a byte of all of them at a time."""
        import numpy as np

        if len(pieces) < FEW:
            known: dict[tuple[int, int], bool] = {}
            for piece, name in pieces:
                self._learn_one(piece, name, known)
            return
        step, top, below, size_of = self.suffixes.step, self.suffixes.top, self.suffixes.below, self.sizes
        lengths = np.array([len(p) for p, _ in pieces])
        data, starts = np.frombuffer(b"".join(p for p, _ in pieces), "u1"), np.cumsum(lengths) - lengths
        longest = int(lengths.max(initial=0))
        # last[e]: for the prefix of e bytes of each piece the last token of its encoding
        last = np.full((longest + 1, len(pieces)), -1, "i4")
        node = np.zeros(len(pieces), "i4")
        for end in range(1, longest + 1):
            first = int(np.searchsorted(lengths, end))  # the pieces from here on have that many bytes
            node[first:] = step[node[first:], data[starts[first:] + end - 1]]
            at, token = np.arange(first, len(pieces)), top[node[first:]]
            while len(at):
                before = end - size_of[token]
                fits = before == 0
                fits[~fits] = self._stay(last[before[~fits], at[~fits]], token[~fits])
                last[end, at[fits]] = token[fits]
                at, token = at[~fits], below[token[~fits]]
        # the ids from the last one back
        at, end, rows, ids = np.arange(len(pieces)), lengths.copy(), [], []
        at, end = at[end > 0], end[end > 0]
        while len(at):
            token = last[end, at]
            rows.append(at)
            ids.append(token)
            end = end - size_of[token]
            at, end = at[end > 0], end[end > 0]
        rows, ids = (np.concatenate(x[::-1]) if x else np.zeros(0, "i4") for x in (rows, ids))
        flat = ids[np.argsort(rows, kind="stable")].astype("<i4").tobytes()
        stops = np.cumsum(np.bincount(rows, minlength=len(pieces))).tolist()
        self.packed.update({name: flat[4 * a:4 * b] for (_, name), a, b in zip(pieces, [0, *stops], stops)})

    def _stay(self, a, b):
        """``stays`` of pairs, out of a table of 1 << ``PAIR_BITS`` known ones."""
        import numpy as np

        pair = a.astype("i8") << 32 | b
        slot = (pair.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype("i8")
        known = self.pairs[slot] == pair
        out = self.pair_stays[slot]
        if not known.all():
            new, where = np.unique(pair[~known], return_inverse=True)
            found = np.array([self.stays(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()])
            out[~known] = found[where]
            self.pairs[slot[~known]], self.pair_stays[slot[~known]] = pair[~known], found[where]
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, added tokens as they are."""
        if self.split_added and any(s in text for s in self.added):
            return [p for part in self.split_added.split(text) for p in ([part] if part in self.added else self.pieces(part))]
        return (self.any if self.beyond.search(text) else self.latin).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.packed)
        if new:
            self.learn(set().union(*split) if len(self.packed) + len(new) > CACHE_ENTRIES else new)
            self.packed.update({s: struct.pack("<i", i) for s, i in self.added.items()})
        return [b"".join(map(self.packed.__getitem__, p)) for p in split]

    def decode(self, ids: list[int]) -> str:
        """Ids back to text, malformed bytes as U+FFFD; unknown ids are left out, as the library does."""
        try:
            found = [*map(self.bytes_of.__getitem__, ids)]
        except KeyError:
            found = [self.bytes_of.get(i, b"") for i in ids]
        return b"".join(found).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _pieces_of_work(batch, text_col: str) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of about ``SLICE_CHARS``: (first row, texts)."""
    start, texts, chars = 0, [], 0
    for i, t in enumerate(batch.column(text_col)):
        texts.append(t.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS:
            yield start, texts
            start, texts, chars = i + 1, [], 0
    if texts:
        yield start, texts


def _arrow_ids(packed: list[bytes]):
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in kinds] + [T.StructField(n, k, False) for n, k in kinds.items()])


IDS = T.ArrayType(T.IntegerType(), False)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as array<int> in ``out``."""
    keep = [n for n in docs.columns if n != out]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, texts in _pieces_of_work(batch, text_col):
                part = batch.slice(start, len(texts))
                ids = _arrow_ids(tokenizer(path).encode(texts))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [ids], names=[*keep, out])
        tokenizer(path).packed.clear()  # idle workers hold no cache

    return docs.mapInArrow(released(run), _with(docs.schema, **{out: IDS}))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids in ``ids_col`` (null: empty) in ``out``."""
    keep = [n for n in docs.columns if n != out]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([tokenizer(path).decode(row.as_py() or []) for row in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [texts], names=[*keep, out])

    return docs.mapInArrow(released(run), _with(docs.schema, **{out: T.StringType()}))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the resulting ids in one pass over the rows."""
    keep = [n for n in docs.columns if n not in (ids, out, text_col)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = tokenizer(path)
        for batch in batches:
            for start, texts in _pieces_of_work(batch, text_col):
                part, packed = batch.slice(start, len(texts)), bpe.encode(texts)
                decoded = pa.array([bpe.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [_arrow_ids(packed), decoded], names=[*keep, ids, out])
        bpe.packed.clear()  # idle workers hold no cache

    return docs.mapInArrow(released(run), _with(docs.drop(text_col).schema, **{ids: IDS, out: T.StringType()}))
