"""Byte-level BPE encoding and decoding (operator 4).

Every regular-expression piece is merged on its own. A minimum segment tree over the byte
positions of a piece keeps, for each live position, the rank of the pair that starts there; its
root is the leftmost pair of least rank. A merge changes at most three positions - the merged one,
its live left neighbour and the right one, which dies - so it costs three logarithmic updates.
Pieces of a batch of like length run side by side as rows of one numpy array.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from brindle.llm.batches import Cache, gathered, ids_of_texts, pooled, slices, texts_of

#: White space that can follow a space, in UTF-8: what \s has in Unicode.
SPACES = rb"[\x09-\x0D\x20]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80"
#: Bytes of pieces and of chunks, with their ids, that a worker keeps.
PIECE_BYTES, CHUNK_BYTES = 48 << 20, 16 << 20
#: A plain chunk: letters with a space before them or none, which are one piece, and ASCII punctuation, which is another. An apostrophe may begin a piece such as 's.
PLAIN = r"^(?P<word> ?\p{L}+)(?P<after>[!-&(-/:-@\[-`{-~]*)$"
#: Stands where a text is cut; a text that has it is not cut.
MARK = b"\x1e"
FREE, MAX_CELLS, LONG = np.int64(2**62), 1 << 19, 256


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; executors get them by broadcast."""
    with open(path, "rb") as f:
        return f.read()


class ByteBpe:
    """Encoder for a rank file, a list of base64 tokens and ranks, with a piece pattern.

    ``pattern`` may use \\s and \\S; they are read as Unicode white space.
    """

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pattern = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        # All splits of a token into two tokens: merging them gives the token's id as its rank.
        merges = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(merges), dtype=np.int64)
        self.pair_ranks = np.array([merges[k] for k in sorted(merges)], dtype=np.int64)
        slots = 1 << int(len(merges) * 4).bit_length()
        self.slot_keys, self.slot_ranks, self.slot_bits = self._hash_table(slots)
        # Pieces, and chunks that are not plain, each with the space or line feed before it.
        self.pieces, self.chunks = Cache(PIECE_BYTES), Cache(CHUNK_BYTES)
        self.decoder = np.full(max(self.rank.values()) + 1, b"", dtype=object)
        for token, rank in self.rank.items():
            self.decoder[rank] = token
        self.cuts = self._cuts_hold()

    def _cuts_hold(self) -> bool:
        """Whether the pattern's pieces of short probes are those of their chunks, and of plain chunks the two parts, as for patterns of words with a space before them.

        Texts are cut only for such a pattern.
        """
        find, plain = self.pattern.findall, regex.compile(PLAIN)
        probes = ["".join(p) for n in range(1, 5) for p in product("a1.'! \n\u00a0\u00e9", repeat=n)]
        for text in probes:
            if cuts_safely(text.encode()):
                chunks = cut(text.encode()).decode().split(MARK.decode())
                if find(text) != [x for c in chunks for x in find(c)] or any(find(c) != [x for x in m.groups() if x] for c in chunks if (m := plain.match(c))):
                    return False
        return True

    def _hash_table(self, slots: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing over the pair keys, filled and probed by whole arrays."""
        bits = slots.bit_length() - 1
        keys, ranks = np.full(slots, -1, dtype=np.int64), np.full(slots, FREE, dtype=np.int64)
        left = np.arange(len(self.pair_keys))
        at = self._slot(self.pair_keys, bits)
        while len(left):
            free = keys[at] < 0
            keys[at[free]] = self.pair_keys[left[free]]
            lost = keys[at] != self.pair_keys[left]
            ranks[at[~lost]] = self.pair_ranks[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & (slots - 1)
        return keys, ranks, bits

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, FREE where they do not merge or one is missing (-1)."""
        key = left << 32 | np.maximum(right, 0)
        at = self._slot(key, self.slot_bits)
        found = self.slot_keys[at]
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slot_keys) - 1)
            again = self.slot_keys[at[rest]]
            rest = rest[(again != key[rest]) & (again >= 0)]
        return np.where((self.slot_keys[at] == key) & (right >= 0), self.slot_ranks[at], FREE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; rows of a like power of two of bytes are merged together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        width = 2 ** np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for i in np.flatnonzero(width > LONG):
            out[i] = self._merge_long(pieces[i], int(width[i]))
        for w in np.unique(width[width <= LONG]):
            rows = np.flatnonzero(width == w)
            step = max(1, MAX_CELLS // int(w))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                for row, ids in zip(some, self._merge_rows([pieces[i] for i in some], int(w)), strict=True):
                    out[row] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        inside = np.arange(width + 1)[None, :] < sizes[:, None]
        ids[inside] = self.byte_ids[flat]
        # Left and right live neighbours; position ``width`` stands for "none".
        right = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        right = np.where(right < sizes[:, None], right, width)
        left = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        # A leaf holds its pair's rank and then its position, so that the leftmost of equals is least.
        shift = max(1, (width - 1).bit_length())
        tree = np.full((n, 2 * width), FREE, dtype=np.int64)
        first = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(first < FREE, (first << shift) | np.arange(width), FREE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < FREE)
        while len(live):
            top = tree[live, 1]
            at, rank = top & ((1 << shift) - 1), top >> shift
            gone = right[live, at]
            after = right[live, gone]
            ids[live, at], right[live, at] = rank, after
            has = after < width
            left[live[has], after[has]] = at[has]
            ids[live, gone] = -1
            before = left[live, at]
            self._put(tree, live, gone, np.full(len(live), FREE), width)
            follow = self.ranks_of(rank, np.where(has, ids[live, after], -1))
            self._put(tree, live, at, np.where(follow < FREE, (follow << shift) | at, FREE), width)
            held = before >= 0
            rows, before = live[held], before[held]
            lead = self.ranks_of(ids[rows, before], rank[held])
            self._put(tree, rows, before, np.where(lead < FREE, (lead << shift) | before, FREE), width)
            live = live[tree[live, 1] < FREE]
        kept = ids[:, :width]
        alive = kept >= 0
        return np.split(kept[alive], np.cumsum(alive.sum(axis=1))[:-1])

    def _merge_long(self, piece: bytes, width: int) -> np.ndarray:
        """One long piece: the same tree in lists, which are faster than arrays of one row."""
        n, shift = len(piece), width.bit_length()
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        first = self.ranks_of(ids, np.append(ids[1:], -1))
        level = np.full(width, FREE, dtype=np.int64)
        level[:n] = np.where(first < FREE, (first << shift) | np.arange(n), FREE)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        free, place = int(FREE), (1 << shift) - 1
        tree = [free, *(x for level in reversed(levels) for x in level.tolist())]
        token, rank_of = self.decoder, self.rank.get
        held, right, left = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        def pair(at: int) -> None:
            after = right[at]
            rank = rank_of(token[held[at]] + token[held[after]]) if after < n else None
            put(at, free if rank is None else rank << shift | at)

        while tree[1] < free:
            at, rank = tree[1] & place, tree[1] >> shift
            gone = right[at]
            held[at], right[at] = rank, right[gone]
            if right[at] < n:
                left[right[at]] = at
            held[gone] = -1
            put(gone, free)
            pair(at)
            if left[at] >= 0:
                pair(left[at])
        return np.array([x for x in held if x >= 0], dtype=np.int64)

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """One point update in each row, carried to the root."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes; those that are no token are merged all at once."""
        ids = [None if (rank := self.rank.get(p)) is None else rank.to_bytes(4, "little") for p in pieces]
        rest = [i for i, v in enumerate(ids) if v is None and pieces[i]]
        for i, found in zip(rest, self.merge([pieces[i] for i in rest]), strict=True):
            ids[i] = found.astype("<u4").tobytes()
        return [v or b"" for v in ids]

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, cut by the pattern."""
        found = [self.pattern.findall(c.decode()) for c in chunks]
        names = list({p for f in found for p in f})
        held = dict(zip(names, self.pieces.ids_of([p.encode() for p in names], self.merged), strict=True))
        return [held[f[0]] if len(f) == 1 else b"".join([held[p] for p in f]) for f in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A piece never spans the place before a space, or on either side of a line feed, that a
        non-space follows. Texts where each space and line feed is of that kind are cut there. Arrow numbers their
        distinct chunks, cuts plain ones into two pieces and numbers those, so that each is looked up once; other texts are taken whole.
        """
        safe = [self.cuts and MARK not in t and cuts_safely(t) for t in texts]
        marked = pa.array([cut(t) for t, ok in zip(texts, safe, strict=True) if ok], pa.binary()).cast(pa.string())
        parts = pc.split_pattern(marked, pattern=MARK.decode())
        numbered = parts.flatten().dictionary_encode()
        chunks = numbered.dictionary
        fields = pc.extract_regex(chunks, pattern=PLAIN)
        plain = fields.is_valid()
        held, other = fields.filter(plain), chunks.filter(pc.invert(plain))
        pieces = pa.concat_arrays([held.field("word"), held.field("after")]).dictionary_encode()
        ids = [*self.pieces.ids_of(pieces.dictionary.cast(pa.binary()).to_pylist(), self.merged), *self.chunks.ids_of(other.cast(pa.binary()).to_pylist(), self.learn)]
        # Two pieces of each plain chunk, one of each other.
        found = np.full((len(chunks), 2), len(ids), dtype=np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        found[mask] = pieces.indices.to_numpy().reshape(2, len(held)).T
        found[~mask, 0] = np.arange(len(pieces.dictionary), len(ids))
        pool, size = gathered(*pooled([*ids, b""]), found.ravel())
        own = iter(ids_of_texts(*gathered(pool, size.reshape(-1, 2).sum(axis=1), numbered.indices.to_numpy()), parts.offsets.to_numpy()))
        whole = iter(self.learn([t for t, ok in zip(texts, safe, strict=True) if not ok]))
        return [next(own) if ok else next(whole) for ok in safe]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.decoder[np.frombuffer(ids, dtype="<u4")].tolist())


#: Where a cut at a space or line feed could fall inside a piece.
UNSAFE = re.compile(rb"(?: |\n)(?:" + SPACES + rb"|\Z)|(?:" + SPACES.replace(rb"\x20", b"") + rb")\n")
#: First bytes of white space, all as a space, to find neighbours quickly; and all other white space.
AS_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def cut(text: bytes) -> bytes:
    return text.replace(b"\n", MARK + b"\n").replace(b" ", MARK + b" ")


def cuts_safely(text: bytes) -> bool:
    even = text.translate(AS_SPACE)
    if b"  " in even or even.endswith(b" "):
        return False
    return text.isascii() or not any(w in text for w in WIDE_SPACES) or UNSAFE.search(text) is None


ENCODERS: dict[tuple[bytes, str], ByteBpe] = {}


def encoder(ranks: bytes, pattern: str) -> ByteBpe:
    """One encoder for each Python worker, with its caches, kept over tasks."""
    key = (hashlib.sha1(ranks).digest(), pattern)
    if key not in ENCODERS:
        ENCODERS[key] = ByteBpe(ranks, pattern)
    return ENCODERS[key]


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``; with ``ids`` also the
    ids (binary, unsigned 32-bit little-endian) and the decoded bytes. Nulls and empty texts have
    no tokens, a null id stays null, repeated rows repeat, other columns are not read, an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                coded = bpe.encode(texts_of(part.column(1)))
                decoded = [bpe.decode(x) for x in coded]
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(coded, pa.binary()), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select(id_column).dtypes[0][1]
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if ids else "")
    return docs.select(id_column, text).mapInArrow(run, schema)
