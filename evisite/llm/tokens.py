"""Whole-text encoding with the tokenizers library, once per distinct piece of text.

Both public vocabularies split a text into pieces that are encoded on their own, so the ids of a text are the joined
ids of its pieces. Here texts are cut only where such a split must fall. Arrow finds the distinct chunks of a batch,
the library encodes those that are new to the worker, and the ids are spread to their places with numpy. The result
equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``; tests hold it against that. Texts that spell
out a special token, which the library turns into one id, go to the library whole. What a worker remembers is bounded.
"""

from __future__ import annotations

import array
import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evisite.llm.common import own_texts

KEEP = 600_000  # chunks, and pieces, that a worker remembers before it starts anew
STEP = 24 << 20  # bytes of text handled at once
PART = 1000  # texts that the library encodes at once; what it returns of each is much larger than its ids

LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
#: The public split patterns of the two vocabularies, for texts of Latin-1 characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
BYTES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WIDE = re.compile("[^\x00-\xff]")
#: Texts in which a cut before each space may not be a split: double spaces, other white space, the cut mark itself.
#: Where Latin-1 texts are cut besides: around digits and marks (words), or before marks that follow a letter or digit.
CUT_WORDS = rf"('(?:s|t|re|ve|m|ll|d)|[0-9\x{{b2}}\x{{b3}}\x{{b9}}\x{{bc}}-\x{{be}}]|[^{SPACE}{LETTER}{DIGIT}]+)"
CUT_BYTES = f"([{LETTER}{DIGIT}])([^{SPACE}{LETTER}{DIGIT}]+)"
ODD = r"  |[\x00\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    def __init__(self, path: str, lower: bool, keep: int = KEEP):
        """``lower``: the vocabulary lower-cases and drops white space (else it is byte-level and keeps spaces)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lower, self.keep, self.path = lower, keep, path
        self.piece = Tokenizer.from_file(path)  # for pieces that are split and lower-cased already
        added = self.piece.get_added_tokens_decoder().values()
        self.marks = "|".join(f"(?i:{re.escape(t.content)})" if t.normalized else re.escape(t.content) for t in added)
        if lower:
            self.piece.normalizer = normalizers.Sequence([])
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    @functools.cached_property
    def whole(self):
        """The library's tokenizer as it is; loaded where a text needs it, since each takes 27 MB of a worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.chunks: dict[str, int] = {}  # to the place in start and count
        self.pieces: dict[str, bytes] = {}  # of chunks of several
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for at in range(0, len(texts), PART) for e in tokenizer.encode_batch_fast(texts[at : at + PART], add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes new chunks: Latin-1 ones by their pieces, others by the library as they are."""
        wide = [c for c in new if WIDE.search(c)]
        ids = dict(zip(wide, self._library(self.whole, wide))) if wide else {}
        if self.lower:
            split = {c: WORDS.findall(c.lower()) for c in new if c not in ids}
        else:
            split = {c: BYTES.findall(c) for c in new if c not in ids}
        known = self.pieces
        unseen = list({p for parts in split.values() for p in parts if p not in known})
        found = dict(zip(unseen, self._library(self.piece, unseen)))
        for c, parts in split.items():
            if len(parts) == 1:  # the chunk itself is remembered, so its piece is not
                ids[c] = known[parts[0]] if parts[0] in known else found[parts[0]]
                continue
            known.update((p, found[p]) for p in parts if p in found)
            ids[c] = b"".join([known[p] for p in parts])
        sizes = np.fromiter((len(ids[c]) for c in new), np.int64, len(new)) // 4
        self.chunks.update(zip(new, range(len(self.count), len(self.count) + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.count = np.concatenate([self.count, sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join([ids[c] for c in new]), "<u4")])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > self.keep or len(self.pieces) > self.keep:
            self._forget()
        odd = {}
        strange = pc.match_substring_regex(texts, self.marks) if self.marks else pa.array(np.zeros(len(texts), bool))
        if not self.lower:
            strange = pc.or_(strange, pc.match_substring_regex(texts, ODD))
        if pc.any(strange).as_py():
            odd = {k: texts[k].as_py() for k in np.flatnonzero(strange.to_numpy(zero_copy_only=False))}
            texts = pc.if_else(strange, "", texts)
        wide = pc.match_substring_regex(texts, r"[^\x00-\x{ff}]")
        if self.lower:
            texts = pc.ascii_lower(texts)
            texts = pc.if_else(wide, texts, pc.replace_substring_regex(texts, CUT_WORDS, r" \1 "))
            lists = pc.ascii_split_whitespace(texts)
        else:
            texts = pc.if_else(wide, texts, pc.replace_substring_regex(texts, CUT_BYTES, "\\1\x00\\2"))
            lists = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        get = self.chunks.get
        place = np.fromiter((-1 if (i := get(w)) is None else i for w in distinct), np.int64, len(distinct))
        if (place < 0).any():
            lost = np.flatnonzero(place < 0)
            first = len(self.count)
            self._learn([distinct[k] for k in lost])
            place[lost] = np.arange(first, first + len(lost))
        place = place[words.indices.to_numpy()]
        counts, starts = self.count[place], self.start[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(starts - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not odd:
            return flat, np.diff(bounds)
        rows = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k, ids in zip(odd, self._library(self.whole, list(odd.values()))):
            rows[k] = np.frombuffer(ids, "<u4")
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and the number of ids of each; a null text has none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        flats, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            flat, n = self._some(own_texts(texts.slice(at, to - at)))
            flats.append(flat)
            counts.append(n)
            at = to
        return np.concatenate(flats), np.concatenate(counts)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower: bool) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if (path, lower) not in _encoders:
        _encoders[path, lower] = Encoder(path, lower)
    return _encoders[path, lower]
