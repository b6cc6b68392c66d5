"""Encoding by distinct words.

Both public vocabularies cut a text wherever a non-space character meets white space, so a text can be cut into chunks (a
run of white space and the run of other characters after it), each distinct chunk encoded once, and the ids put back in
order.  Chunks, not texts, go to the tokenizers library.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    tok = load(path)
    batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return [np.array(e.ids, dtype="<u4").tobytes() for e in batch(words, add_special_tokens=False)]


#: Words without the white space before them, for vocabularies that drop it.
BARE = re.compile(f"[^{WHITE}]+")

#: A text that cannot be lowered and cut before normalisation: characters beyond Latin-1, or control strings, which are told by their case.
ODD = r"<\||[^\x{0}-\x{ff}]"

#: A plain word is of these small ASCII and Latin-1 letters, and of these marks after them.
LETTERS = "".join(map(chr, [*range(97, 123), *range(223, 247), *range(248, 256)]))
MARKS = ".,!?;:#$%&*|"


class lower_encoder:
    """Encodes the texts of one task with a vocabulary that lowers letters and drops white space.

    Arrow cuts the texts and finds the distinct words of a batch; their ids go back to the places by ``take``.  The letters of plain
    words, lower case already and unchanged by normalisation, go to the vocabulary's merges at once, without the passes before them,
    and each spelling once as long as the cache holds it; all other words go through the library whole."""

    def __init__(self, path: str, most: int = 400_000):
        self.path, self.most, self.known, self.stems = path, most, {}, {}
        self.model = load(path).model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in keep)} | {10: "\n"}
        self.letters = "".join(letter.get(b, chr(b)) for b in range(256))
        self.four: dict[int, bytes] = {}

    def _merge(self, stems: list[str]) -> list[bytes]:
        merge, four = self.model.tokenize, self.four
        spelled = codecs.charmap_decode("\n".join(stems).encode(), "strict", self.letters)[0].split("\n")
        ids = [[t.id for t in merge(w)] for w in spelled]
        four.update((k, struct.pack("<I", k)) for k in set(chain.from_iterable(ids)).difference(four))
        return [b"".join([four[k] for k in own]) for own in ids]

    def _whole(self, words: list[str]) -> list[bytes]:
        return encode_words(self.path, words)

    def _look_up(self, words: pa.Array, known: dict[str, bytes], encode) -> pa.Array:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = distinct
        if new:
            known.update(zip(new, encode(new), strict=True))
        return pa.array([known[w] for w in distinct], pa.large_binary()).take(coded.indices)

    def _encode(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        ends = pc.utf8_ltrim(words, characters=LETTERS)
        plain = pc.and_(pc.equal(pc.utf8_ltrim(ends, characters=MARKS), ""), pc.not_equal(ends, words))
        stems = self._look_up(pc.utf8_rtrim(words.filter(plain), characters=MARKS), self.stems, self._merge)
        after = self._look_up(ends.filter(plain), self.known, self._whole)
        rest = self._look_up(words.filter(pc.invert(plain)), self.known, self._whole)
        joined = pc.binary_join_element_wise(stems, after, pa.scalar(b"", pa.large_binary()))
        own = plain.to_numpy(zero_copy_only=False)
        place = np.where(own, np.cumsum(own) - 1, len(joined) + np.cumsum(~own) - 1)
        return pa.concat_arrays([joined, rest]).take(pa.array(place, pa.int64()))

    def _join(self, lists: pa.Array) -> list[bytes]:
        """Ids of the texts of which ``lists`` has the words."""
        words = lists.flatten()
        if not len(words):
            return [b""] * len(lists)
        coded = words.dictionary_encode()
        ids = self._encode(coded.dictionary).take(coded.indices)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset + np.concatenate([[0], ends])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        lowered = pc.utf8_lower(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " "))
        simple = iter(self._join(pc.split_pattern(lowered, " ")))
        cut = [BARE.findall(t) for t in texts.filter(odd).to_pylist()]
        others = iter(self._join(pa.array(cut, pa.large_list(pa.large_string()))))
        return [next(others if o else simple) for o in odd.to_pylist()]
