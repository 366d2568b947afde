"""Token ids of whole texts by a tokenizers-library vocabulary that drops white space.

White space never enters a token of such a vocabulary, so that a text's ids are those of its
parts between ASCII white space, in order. Each Python worker keeps the ids of parts it has met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from brindle.llm.batches import Cache, gathered, ids_of_texts, pooled

#: Bytes of parts with their ids that a worker keeps.
CACHE_BYTES = 64 << 20
#: A word of Latin letters up to U+00FF, and ASCII punctuation before and after it: three pieces, each of which is one for the library too.
#: Left out: apostrophes, which begin pieces such as 's, and what special tokens have around them.
PUNCTUATION = r'[!-&(-/:;=-@\[-`{}~]*'
PLAIN = "^(?P<before>" + PUNCTUATION + ")(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>" + PUNCTUATION + ")$"
#: Fixed by byte-level vocabularies: bytes that print stand for themselves, the others for the letters from U+0100 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PRINTED)}
LETTERS = {c: "".join(BYTE_LETTERS.get(b, chr(b)) for b in c.encode()) for c in map(chr, range(0xDF, 0x100))}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class WordIds:
    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # The library's own cache of pieces does not help: few parts are given to it twice.
        self.tokenizer.model._resize_cache(0)
        # Whether an id ends a piece, where the vocabulary marks that.
        held, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(held.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in held.items() if token.endswith(suffix)]] = True
        self.known = Cache(CACHE_BYTES)

    def run(self, words: list[str]) -> list[bytes]:
        """Ids of words by the whole tokenizer: all its steps, words parted by their places."""
        out: list[bytes] = []
        for first in range(0, len(words), 50_000):
            some = words[first : first + 50_000]
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            coded = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            at = np.fromiter((a for a, _ in coded.offsets), dtype=np.int64, count=len(ids) // 4)
            cut = (np.searchsorted(at, starts) * 4).tolist()
            out += [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def run_plain(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of single pieces, lowered: the library's model is all they need, and its marks of an end part them."""
        out: list[bytes] = []
        for first in range(0, len(pieces), 50_000):
            some = pieces[first : first + 50_000]
            text = b"\n".join(some).decode()
            if not text.isascii():
                # Lower letters alone, whose stand-ins are none of them: a search for each is faster than a look at every character.
                for letter, stands in LETTERS.items():
                    text = text.replace(letter, stands)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or (len(cut) and cut[-1] != len(ids)):
                out += self.run([p.decode() for p in some])
                continue
            held, at = ids.tobytes(), [0, *(cut * 4).tolist()]
            out += [held[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens added."""
        return next(self.encode_slices([texts])) if texts else []

    def encode_slices(self, slices: Iterable[list[bytes]]) -> Iterator[list[bytes]]:
        """``encode`` of each slice of texts; what is held of a slice meanwhile is its distinct parts and their numbers.

        Arrow cuts the texts and numbers their distinct parts, cuts these into pieces and numbers those, so that each piece is looked up once for all slices given.
        """
        cut = []
        for texts in slices:
            # The vocabulary has lower case only. Lowering ASCII early means fewer parts to learn, but not
            # where accents compose or where it could spell a special token.
            parts = pc.ascii_split_whitespace(pa.array([lowered(t) for t in texts], pa.binary()).cast(pa.string()))
            numbered = parts.flatten().dictionary_encode()
            cut.append((parts.offsets.to_numpy(), numbered.indices.to_numpy(), numbered.dictionary))
        if not cut:
            return
        joint = pa.concat_arrays([words for _, _, words in cut]).dictionary_encode()
        whole, size = self.ids_of_words(joint.dictionary)
        numbers, first = joint.indices.to_numpy(), 0
        for offsets, indices, words in cut:
            yield ids_of_texts(*gathered(whole, size, numbers[first : first + len(words)][indices]), offsets)
            first += len(words)

    def ids_of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` ids of distinct words."""
        fields = pc.extract_regex(words, pattern=PLAIN)
        plain = fields.is_valid()
        held, other = fields.filter(plain), words.filter(pc.invert(plain))
        n = len(held)
        pieces = pa.concat_arrays([held.field("before"), pc.utf8_lower(held.field("word")), held.field("after")]).dictionary_encode()
        ids = [*self.known.ids_of(pieces.dictionary.cast(pa.binary()).to_pylist(), self.run_plain), *self.known.ids_of(other.cast(pa.binary()).to_pylist(), lambda new: self.run([w.decode() for w in new]))]
        # Three pieces of each plain word, one of each other.
        found = np.full((len(words), 3), len(ids), dtype=np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        found[mask] = pieces.indices.to_numpy().reshape(3, n).T
        found[~mask, 0] = np.arange(len(pieces.dictionary), len(ids))
        whole, size = gathered(*pooled([*ids, b""]), found.ravel())
        return whole, size.reshape(-1, 3).sum(axis=1)


def lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() and b"<|" not in text else text


ENCODERS: dict[bytes, WordIds] = {}


def encoder(vocabulary: bytes) -> WordIds:
    """One encoder for each Python worker, kept over tasks."""
    key = hashlib.sha1(vocabulary).digest()
    if key not in ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ENCODERS[key] = WordIds(vocabulary)
    return ENCODERS[key]
