"""Exact, cached sub-word encoding shared by the token operators.

A byte-pair tokenizer never merges across its pre-token boundaries, so the ids
of a text are the ids of its white-space separated chunks, one after another.
Natural text repeats its words: each worker keeps the ids of the chunks it has
met and asks the tokenizers library (its own normaliser, pre-tokenizer and
model) only for new ones.  The cache is bounded: two generations of at most
``limit`` entries, the older one dropped when the younger is full, so memory
does not follow the corpus.  ``many`` takes a column of texts at a time: Arrow
splits it and finds its distinct words, known ones are looked up there, and
numpy lays the ids out, so Python meets new words only.  Texts for which chunks could differ from the whole
(runs of spaces, other white space, the strings of special tokens) are given to
the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = "\x1c\x1d\x1e\x1f"
#: White space of Unicode beyond ASCII.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: ASCII punctuation: a run of these after letters is one piece.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE, NEWLINE = "\u0120", "\u010a"  # byte-level letters for a space and a line feed


def _laid(at: np.ndarray, size: np.ndarray, bag: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``bag[at : at + size]`` of ``which``, end to end, and the size of each."""
    n = size[which]
    total = np.cumsum(n)
    place = np.arange(int(total[-1]) if len(total) else 0, dtype=np.int32)
    place += np.repeat((at[which] - (total - n)).astype(np.int32), n)
    return bag[place], n


class _Table:
    """At most ``limit`` keys and their ids, in Arrow and numpy: no Python object a key.

    When it is full, the keys found since the last time stay, half of it at most.
    """

    def __init__(self, dtype: np.dtype, limit: int):
        self.limit = limit
        self.keys = pa.array([], pa.string())
        self.at, self.size, self.bag, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, bool)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, number) of the ids of each key in the third, the bag; and which keys are unknown."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.bag, np.arange(len(keys))
        i = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False)
        known = i >= 0
        self.used[i[known]] = True
        return np.where(known, self.at[i], 0), np.where(known, self.size[i], 0), self.bag, np.flatnonzero(~known)

    def add(self, keys: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.limit:
            keep = np.flatnonzero(self.used)[-(self.limit // 2) :]
            self.bag, self.size = _laid(self.at, self.size, self.bag, keep)
            self.at = np.cumsum(self.size) - self.size
            self.keys, self.used = self.keys.take(pa.array(keep)), np.zeros(len(keep), bool)
        self.at = np.concatenate([self.at, len(self.bag) + np.cumsum(n) - n])
        self.size, self.bag = np.concatenate([self.size, n]), np.concatenate([self.bag, ids])
        self.keys, self.used = pa.concat_arrays([self.keys, keys]), np.concatenate([self.used, np.zeros(len(keys), bool)])


class ChunkEncoder:
    """Ids (and character spans) of texts, equal to ``Tokenizer.encode``.

    ``path`` is a tokenizers JSON file.  Two layouts are known: byte-level with
    the space kept at the front of a word, and lower-casing ones that drop white
    space; any other file is encoded whole, text by text.
    """

    def __init__(self, path: str, limit: int = 250_000, spans: bool = False, table: int = 200_000, table_pieces: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and norm is None and not pre.get("add_prefix_space"):
            self.kind = "space"
        elif norm and json.dumps(pre).find('"Removed"') > 0 and r"\s" in json.dumps(pre):
            self.kind = "word"
        if spec.get("post_processor") is not None:
            self.kind = "whole"
        self.limit, self.want_spans = limit, spans
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.table: dict = {}
        if self.kind != "whole":
            from tokenizers.pre_tokenizers import ByteLevel

            level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.table = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(32, 256)}
        self.odd = self._odd_pattern()
        self.known, self.known_pieces = _Table(self.dtype, table), _Table(self.dtype, table_pieces)
        self.new: dict = {}
        self.old: dict = {}
        self.pieces: dict = {}
        self.old_pieces: dict = {}

    # ----- pieces and chunks -------------------------------------------------
    def _piece(self, piece: str):
        got = self.pieces.get(piece)
        if got is None:
            got = self.old_pieces.get(piece)
            if got is None:
                got = array(self.code, [t.id for t in self.tok.model.tokenize(piece)]).tobytes()
            if len(self.pieces) >= self.limit:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _miss(self, key: str):
        """Ids of a chunk; with spans also [(start, end)] in its characters."""
        got = self.old.get(key)
        if got is None:
            if self.want_spans:
                got = self._with_spans(self._text_of(key))
            elif (pieces := self._plain(key)) is not None:
                got = b"".join([self._piece(p) for p in pieces])
            else:
                text = self._text_of(key)
                if self.tok.normalizer is not None:
                    text = self.tok.normalizer.normalize_str(text)
                got = b"".join([self._piece(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)])
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = got
        return got

    def _plain(self, key: str):
        """The byte-level pieces of a Latin-1 word with ASCII marks after it.

        Such words are one run of letters and one of marks to every pre-tokenizer
        here and are in normal form C already, so the library need not split them.
        """
        first = key[:1]
        word = key[1:] if first == "\x00" or first == "\x01" else key
        last = ""
        if word[-1:] in _MARKS:
            whole, word = word, word.rstrip(_MARKS)
            last = whole[len(word) :]
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0100"):
            return None
        if self.kind == "word":
            word = word.lower()
            return (word.translate(self.table), last) if last else (word.translate(self.table),)
        if first == "\x00":
            pieces = [NEWLINE, word.translate(self.table)]
        else:
            pieces = [word.translate(self.table) if first == "\x01" else SPACE + word.translate(self.table)]
        return [*pieces, last] if last else pieces

    def _text_of(self, key: str) -> str:
        if self.kind == "word":
            return key
        if key[:1] == "\x01":
            return key[1:]
        return "\n" + key[1:] if key[:1] == "\x00" else " " + key

    def _with_spans(self, text: str):
        e = self.tok.encode(text, add_special_tokens=False)
        return (
            np.array(e.ids, self.dtype).tobytes(),
            np.array(e.offsets, "<i4").reshape(-1, 2).tobytes(),
            len(text),
        )

    def _keys(self, text: str):
        """The chunks of a text, or None if it must be encoded whole."""
        if self.kind == "whole" or any(s in text for s in self.specials):
            return None
        if any(c in text for c in _ODD) or "\x00" in text or "\x01" in text:
            return None
        if self.kind == "word":
            return text.split()
        # single spaces and line feeds only, none at an end
        if any(c in text for c in _PAIRS) or text[0] in " \n" or text[-1] in " \n":
            return None
        if not text.isascii() and any(c in text for c in _WIDE):
            return None
        keys = text.replace("\n", " \x00").split(" ")
        if keys[0][:1] != "\x00":
            keys[0] = "\x01" + keys[0]
        return keys

    def _odd_pattern(self) -> str:
        """What makes a text be encoded whole, as one RE2 pattern; the same tests as ``_keys``."""
        odd = [re.escape(s) for s in self.specials]
        if self.kind == "word":
            odd.append(r"[\x00\x01\x1c-\x1f" + _WIDE + "]")
        else:
            odd += [r"[\x00\x01\x1c-\x1f\t\r\x0b\x0c" + _WIDE + "]", "  | \n|\n |\n\n", r"\A[ \n]|[ \n]\z"]
        return "|".join(odd)

    def _fresh(self, key: str) -> bytes:
        """Ids of a key by the library, unremembered."""
        if not key and self.kind == "word":
            return b""
        if (pieces := self._plain(key)) is None:
            text = self._text_of(key)
            if self.tok.normalizer is not None:
                text = self.tok.normalizer.normalize_str(text)
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join([self._tokenized(p) for p in pieces])

    def _tokenized(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tok.model.tokenize(piece)]).tobytes() if piece else b""

    def _ragged(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows), self.dtype), np.fromiter(map(len, rows), np.int64, len(rows)) // self.dtype.itemsize

    def _new_ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their number in each key) of keys that aren't known yet.

        ASCII words with marks after them are cut into pieces here, as ``_plain``
        does; of those, only the pieces never met go to the library.
        """
        cut = pc.extract_regex(keys, r"\A(?P<p>[\x00\x01]?)(?P<w>[A-Za-z]+)(?P<m>[!-/:-@\[-`{-~]*)\z")
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        flat, counts = self._ragged([self._fresh(k) for k in keys.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()])
        if not plain.any():
            return flat, counts
        p, w, m = cut.filter(pa.array(plain)).flatten()
        if self.kind == "word":
            parts = [pc.ascii_lower(w), m]
        else:
            parts = [pc.if_else(pc.equal(p, "\x00"), NEWLINE, ""), pc.if_else(pc.equal(p, ""), pc.binary_join_element_wise(SPACE, w, ""), w), m]
        pieces = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts]).dictionary_encode()
        at, size, bag, new = self.known_pieces.find(pieces.dictionary)
        if len(new):
            fresh = pieces.dictionary.take(pa.array(new))
            more, n = self._ragged(list(map(self._tokenized, fresh.to_numpy(zero_copy_only=False).tolist())))
            at[new], size[new] = len(bag) + np.cumsum(n) - n, n
            bag = np.concatenate([bag, more])
            self.known_pieces.add(fresh, more, n)
        by_key = pieces.indices.to_numpy().reshape(len(parts), -1).T.reshape(-1)
        ids, n = _laid(at, size, bag, by_key)
        n = n.reshape(-1, len(parts)).sum(axis=1)
        if plain.all():
            return ids, n
        total = np.zeros(len(keys), np.int64)
        total[plain], total[~plain] = n, counts
        start = np.zeros(len(keys), np.int64)
        start[plain], start[~plain] = np.cumsum(n) - n, len(ids) + np.cumsum(counts) - counts
        return _laid(start, total, np.concatenate([ids, flat]), np.arange(len(keys)))

    def _words_of(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """(the end of each text in words, the words' keys) of texts that may be cut."""
        if self.kind == "word":
            words = pc.ascii_split_whitespace(texts)
        else:
            words = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\x01", texts, ""), "\n", " \x00"), " ")
        ends = words.offsets.to_numpy()[1:].astype(np.int64) - words.offsets[0].as_py()
        return ends, words.flatten().dictionary_encode()

    def _slices(self, texts: pa.Array, most: int) -> Iterator[pa.Array]:
        """Parts of a column with at most ``most`` bytes, or one text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield texts.slice(i, j - i)
            i = j

    # ----- public ------------------------------------------------------------
    def many(self, texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids end to end, their number in each text) of slices of a column without nulls, in order."""
        for part in self._slices(texts, most):
            if self.kind == "whole":
                cut = np.zeros(len(part), bool)
            else:
                cut = ~pc.match_substring_regex(part, self.odd).to_numpy(zero_copy_only=False)
                cut &= pc.binary_length(part).to_numpy(zero_copy_only=False) > 0
            flat, counts = np.zeros(0, self.dtype), np.zeros(len(part), np.int64)
            if cut.any():
                ends, words = self._words_of(part if cut.all() else part.filter(pa.array(cut)))
                at, size, bag, new = self.known.find(words.dictionary)
                if len(new):
                    fresh = words.dictionary.take(pa.array(new))
                    more, n = self._new_ids(fresh)
                    at[new], size[new] = len(bag) + np.cumsum(n) - n, n
                    bag = np.concatenate([bag, more])
                    self.known.add(fresh, more, n)
                flat, n = _laid(at, size, bag, words.indices.to_numpy())
                counts[cut] = np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)
            if not cut.all():
                whole = [np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype) for t in part.filter(pa.array(~cut)).to_pylist()]
                ends = np.cumsum(counts[cut])
                cells = iter(np.split(flat, ends[:-1]) if len(ends) else [])
                other = iter(whole)
                laid = [next(cells) if c else next(other) for c in cut.tolist()]
                counts[~cut] = [len(w) for w in whole]
                flat = np.concatenate(laid) if laid else flat
            yield flat, counts

    def ids(self, text: str) -> np.ndarray:
        """Token ids of ``text`` without special tokens."""
        if not text:
            return np.zeros(0, self.dtype)
        keys = self._keys(text)
        if keys is None:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)
        got = list(map(self.new.get, keys))
        if None in got:
            miss, new = self._miss, self.new.get
            for i in [i for i, g in enumerate(got) if g is None]:
                got[i] = new(keys[i]) or miss(keys[i])
        return np.frombuffer(b"".join(got), self.dtype)

    def ids_and_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their (start, end) in code points of ``text``."""
        if not self.want_spans:
            raise ValueError("made without spans=True")
        if not text:
            return np.zeros(0, self.dtype), np.zeros((0, 2), np.int64)
        keys = self._keys(text) if self.kind == "space" else None
        if keys is None:
            e = self.tok.encode(text, add_special_tokens=False)
            return np.array(e.ids, self.dtype), np.array(e.offsets, np.int64).reshape(-1, 2)
        got = [self.new.get(k) or self._miss(k) for k in keys]
        ids = np.frombuffer(b"".join([g[0] for g in got]), self.dtype)
        spans = np.frombuffer(b"".join([g[1] for g in got]), "<i4").reshape(-1, 2).astype(np.int64)
        sizes = np.array([g[2] for g in got], np.int64)
        counts = np.array([len(g[0]) for g in got], np.int64) // self.dtype.itemsize
        return ids, spans + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]


_ENCODERS: dict = {}


def encoder(path: str, spans: bool = False) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if (path, spans) not in _ENCODERS:
        # with spans, words are only in the dictionaries, so these are larger
        _ENCODERS[path, spans] = ChunkEncoder(path, limit=600_000 if spans else 250_000, spans=spans)
    return _ENCODERS[path, spans]


def release() -> None:
    """Forget this worker's caches: for stages that don't encode, in workers that did."""
    _ENCODERS.clear()
