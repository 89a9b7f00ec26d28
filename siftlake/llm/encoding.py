"""Exact tokenizer ids for Arrow text columns, encoding each distinct word once.

Byte-pair encoders of the two kinds used here never merge across the start of a single space or line end between two
non-spaces.  A text is therefore cut there, equal pieces are encoded once by the tokenizers library and the ids
put together again.  A text with any other use of white space is encoded whole.
"""

from __future__ import annotations

import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from siftlake.llm.shared import unsliced

#: White space other than single spaces and line ends between words, where cutting at spaces would not be exact.
IRREGULAR = r"[\s\x0b][\s\x0b]|^[\s\x0b]|[\s\x0b]$|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: New pieces in one call of the library, which takes longer for each piece of a long text.
TOGETHER = 100
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def encoder(path: str, room: int = 700_000) -> Encoder:
    """The encoder of this worker process for a tokenizer file, with its cache of at most ``room`` pieces from here on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, room)
    found = _ENCODERS[path]
    found.room = room
    if len(found.place) > room:
        found._clear()
    return found


class Encoder:
    """Ids of whole texts.  The cache of pieces is emptied when it holds ``room`` pieces, which bounds memory and changes no id."""

    def __init__(self, path: str, room: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        #: Encoders split between a letter and these marks at a word's end; none of them stands in an added token.
        self.marks = "".join(c for c in string.punctuation if not any(c in s for s in self.special))
        #: A token that the library cuts out before it normalises or splits the rest, with its id.
        self.mark = next(((t.content, i) for i, t in added.items() if t.special and not t.normalized and not t.single_word and not t.lstrip and not t.rstrip), None)
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        #: Bytes that each id stands for, where ids cover the text byte by byte.
        self.widths = None
        if self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.widths[i] = len(token)
        #: How many ids stand for a line end, with which the first piece of a text is looked up.
        self.lead = len(self._ids("\n"))
        self._clear()

    def _clear(self) -> None:
        #: Places of pieces without the space before them, and of marks at their ends.  Place 0 is nothing.
        self.place: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.known = [np.zeros(2, np.int64)], 1

    def _ids(self, text: str) -> np.ndarray:
        # A batch of one, since the library then leaves out the offsets.
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode new pieces, many in one text, cut the ids apart again and return the pieces' places.

        Without a normaliser, ids of byte-level pieces are cut by the bytes they stand for.  Otherwise a special token
        between two pieces makes the library treat them as separate texts.
        """
        space, nothing = pa.scalar(" ", pieces.type), pa.scalar("", pieces.type)
        pieces = pc.binary_join_element_wise(pc.if_else(pc.starts_with(pieces, "\n"), nothing, space), pieces, nothing)
        alone = np.full(len(pieces), self.widths is None and self.mark is None or any(" " in s for s in self.special))
        for s in self.special:
            alone |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        places = np.empty(len(pieces), np.int64)
        if alone.any():
            found = [self._ids(p) for p in pieces.filter(pa.array(alone)).to_pylist()]
            places[alone] = self._keep(np.concatenate(found), np.array([len(x) for x in found]))
            pieces = pieces.filter(pa.array(~alone))
        if not len(pieces):
            return places
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        texts = (names[a:a + TOGETHER] for a in range(0, len(names), TOGETHER))
        if self.widths is not None:
            ids = np.concatenate([self._ids("".join(some)) for some in texts])
            ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64))
            lengths = np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1, prepend=0)
        else:
            ids = np.concatenate([self._ids(self.mark[0] + self.mark[0].join(some)) for some in texts])
            marks = np.flatnonzero(ids == self.mark[1])
            lengths, ids = np.append(marks[1:], len(ids)) - marks - 1, np.delete(ids, marks)
        places[~alone] = self._keep(ids, lengths)
        return places

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        end, first = self.used + len(ids), self.known
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used:end] = ids
        self.known += len(lengths)
        self.starts.append(self.used + np.cumsum(lengths))
        self.used = end
        return np.arange(first, self.known)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of different pieces are kept; new pieces are learned."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.place.get, names, repeat(0)), np.int64, len(names))
        new = np.flatnonzero(places == 0)
        if len(new) and len(self.place) + len(new) > self.room:
            self._clear()
            new = np.arange(len(names))
        if len(new):
            places[new] = self._learn(pieces.take(pa.array(new)))
            self.place.update(zip(map(names.__getitem__, new.tolist()), places[new].tolist(), strict=True))
        return places

    def _letter(self, c: str) -> bool:
        """Whether a character is a letter that still ends in one after the normaliser, which takes some apart."""
        return c.isalpha() and (self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(c)[-1:].isalpha())

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different words one after another, where each begins, and the end)."""
        cores = pc.utf8_rtrim(words, characters=self.marks)
        last = pc.utf8_slice_codeunits(cores, -1).dictionary_encode()
        letter = np.array([self._letter(c) for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        cores = pc.if_else(pa.array(letter), cores, words)
        slots = np.zeros((len(words), 2), np.int64)
        own = cores.dictionary_encode()
        slots[:, 0] = self._places(own.dictionary)[own.indices.to_numpy()]
        cut = pc.binary_length(words).to_numpy() - pc.binary_length(cores).to_numpy()
        ended = np.flatnonzero(cut)
        tails = [w[-n:] for w, n in zip(words.take(pa.array(ended)).to_numpy(zero_copy_only=False).tolist(), cut[ended].tolist(), strict=True)]
        for tail in {*tails}.difference(self.tails):
            ids = self._ids(tail)
            self.tails[tail] = int(self._keep(ids, np.array([len(ids)]))[0])
        slots[ended, 1] = [self.tails[t] for t in tails]
        starts = np.concatenate(self.starts)
        self.starts = [starts]
        begin = starts[slots.ravel()]
        ids, ends = _gather(self.ids, begin, starts[slots.ravel() + 1] - begin)
        return ids, np.concatenate([[0], ends[1::2]])

    def encode(self, texts: pa.Array, step: int = 6 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts).  Null counts as empty.

        Texts of about ``step`` bytes are worked on at a time, which bounds memory; a longer text is a step of its own.
        """
        texts = pc.fill_null(unsliced(texts).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        found, a = [(np.zeros(0, np.int32), np.zeros(1, np.int64))], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
            found.append(self._encode(unsliced(texts.slice(a, b - a))))
            a = b
        shifts = np.cumsum([0] + [len(ids) for ids, _ in found])
        return np.concatenate([ids for ids, _ in found]), np.concatenate([[0]] + [offsets[1:] + shift for (_, offsets), shift in zip(found, shifts, strict=False)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lowers and not any(pc.any(pc.match_substring(texts, t, ignore_case=True)).as_py() for t in self.special):
            texts = pc.ascii_lower(texts)
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd)) if odd.any() else texts
        # A piece starts with its line end or, left out here, its space.  The first piece of a text is looked up as that of a line.
        line, nothing = pa.scalar("\n", even.type), pa.scalar("", even.type)
        lists = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(even, "\n", " \n"), nothing), " ")
        ends = lists.offsets.to_numpy()
        flat = lists.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        own, starts = self._words(flat.dictionary)
        begin = starts[codes]
        length = starts[codes + 1] - begin
        leads = ends[:-1] - ends[0]
        begin[leads] += self.lead
        length[leads] -= self.lead
        ids, piece_ends = _gather(own, begin, length)
        text_ends = np.concatenate([[0], piece_ends])[ends - ends[0]]
        if not odd.any():
            return ids, text_ends
        whole = [np.asarray(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        lengths = np.empty(len(texts), np.int64)
        lengths[~odd], lengths[odd] = np.diff(text_ends), [len(x) for x in whole]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(offsets[-1], np.int32)
        from_odd = np.repeat(odd, lengths)
        out[~from_odd] = ids
        out[from_odd] = np.concatenate(whole)
        return out, offsets


def _gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[begin : begin + length]`` one after another, and where each ends."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin - (ends - length), length) + np.arange(total)], ends


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Put the id that ends a document after each one."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
