"""Token ids by tokenizer library, with one library call per distinct piece of text instead of one per occurrence.

Both vocabularies split a text into pieces first and encode each piece alone, so the ids of a text are those of its
pieces in order. A worker keeps what it encoded last, up to twice ``limit`` entries a store, which changes the
speed only. A tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from cachesight.llm.common import WordHashes, chunks

#: Between a character that is no white space and a space, a new piece begins in either vocabulary.
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: White space other than one space or newline between words: there the place where a piece begins depends on what follows.
WIDE_SPACE = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]")
#: Fixed value: the splitting pattern inside word_bpe_49k.json.
WORD_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: how an id's text says there that it is a word's last.
SUFFIX = "</w>"
MARKS = (".", ",")
#: White space between words where case is folded, and bytes behind which a mark is a piece of its own.
_BETWEEN = np.isin(np.arange(256), [10, 32])
_ALONE = np.array([chr(k).isascii() and chr(k).isalnum() for k in range(256)])
#: A word of letters that are alike in all Unicode versions, and one mark behind it: two pieces in either vocabulary.
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_AND_MARK = re.compile(rf"({WORD.pattern})([.,]?)")
LIMIT = 600_000
#: Texts that go to the library as one.
JOINED = 2000


class Pieces:
    """``many(texts)``: of each text the number of its ids (``counts``), or the ids as bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u2", counts: bool = False, limit: int = LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype, self.counts, self.limit = np.dtype(dtype), counts, limit
        added = self.library.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in added.items()), (None, None))
        pre = json.loads(self.library.to_str()).get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        spaced = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
        #: White space is dropped and case is folded, so a word has the same ids wherever it stands.
        self.folds = steps[0].get("type") == "Split" and steps[0].get("pattern", {}).get("Regex") == WORD_PIECE
        plain = self.mark is not None and not any(t.lstrip or t.rstrip or " " in t.content for t in added.values())
        self.separable = bool((spaced or self.folds) and plain)
        self.words = Store(limit)  # chunks behind a space, as they stand there
        self.others = Store(limit)  # the same without marks
        self.begins = Store(limit // 4)  # chunks at the begin of a line
        self.table = Table(limit, self.dtype)  # words where case is folded
        if self.folds:
            self.last = np.zeros(self.library.get_vocab_size(), bool)
            self.last[[i for t, i in self.library.get_vocab().items() if t.endswith(SUFFIX)]] = True
        if self.separable:
            texts = ["\n", *MARKS]
            ids = [np.array(self.library.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
            self.newline, *marks = self._library(texts)
            self.ends = dict(zip(MARKS, marks, strict=True)) | {"": 0 if counts else b""}
            self.mark_ids = dict(zip(MARKS, ids[1:], strict=True))

    def _library(self, texts: list[str]) -> list:
        """Each text by itself. They go to the library as one text, between added tokens, which part texts exactly."""
        counts = self.counts and not self.folds  # the table holds ids
        out: list = [None] * len(texts)
        joined = [k for k, t in enumerate(texts) if self.mark not in t]
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(texts[k] for k in part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark_id)
            begin, end = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            assert len(begin) == len(part), "an added token was lost"
            data = None if counts else ids.astype(self.dtype)
            for k, b, e in zip(part, begin, end, strict=True):
                out[k] = e - b if counts else data[b:e].tobytes()
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k] = self._one(self.library.encode_batch_fast([t], add_special_tokens=False)[0], counts)
        return out

    def _one(self, e, counts: bool):
        return len(e.ids) if counts else np.array(e.ids, self.dtype).tobytes()

    def _plain(self, words: list[str]) -> list:
        """Ids of words of letters. Their last ids say that they are the last, so words go to the library as one text."""
        out: list = []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            if len(cuts) != len(part) + 1 or cuts[-1] != len(ids):
                out += self._library(part)
                continue
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            out += [data[b * size : e * size] for b, e in zip(cuts, cuts[1:])]
        return out

    def _folded(self, texts: list[bytes]) -> list:
        """Of texts whose words have the same ids wherever they stand: each distinct word is looked up by its hash."""
        h = WordHashes(texts, _BETWEEN)
        end = h.end.copy()
        before, last = h.bytes[np.maximum(end - 2, 0)], h.bytes[end - 1]
        marks = [(end - h.start > 1) & _ALONE[before] & (last == ord(m)) for m in self.ends if m]
        marked = np.logical_or.reduce(marks)  # the mark is a piece of its own
        end[marked] -= 1
        hashes, at, word = np.unique(h.hashes(h.start, end), return_index=True, return_inverse=True)
        data = h.bytes.tobytes()
        place = self.table.find(hashes, lambda new: self._words([data[b:e].decode() for b, e in zip(h.start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]))
        length = self.table.length[place][word]
        stop = np.concatenate([[0], np.cumsum(length + marked)])
        bounds = stop[h.first].tolist()
        if self.counts:
            return np.diff(bounds).tolist()
        begin = self.table.begin[place][word]
        out = np.empty(stop[-1], self.dtype)
        out[np.arange(length.sum()) + np.repeat(stop[:-1] - np.cumsum(length) + length, length)] = self.table.ids[np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)]
        for m, own in zip((m for m in self.ends if m), marks, strict=True):
            out[stop[1:][own] - 1] = np.frombuffer(self.mark_ids[m], self.dtype)[0]
        return [out[b:e].tobytes() for b, e in zip(bounds, bounds[1:])]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, all ids) of words."""
        plain = np.array([WORD.fullmatch(w) is not None for w in words], bool)
        values = np.empty(len(words), object)
        for own, encode in ((plain, self._plain), (~plain, self._library)):
            if own.any():
                values[own] = encode([words[k] for k in np.flatnonzero(own)])
        ids = np.frombuffer(b"".join(values), self.dtype)
        return np.fromiter(map(len, values), np.int64, len(words)) // self.dtype.itemsize, ids

    def _learn(self, chunks: list[str]) -> list:
        """Values of chunks that stand behind a space; a mark behind a word is a piece of its own."""
        split = [(m[1], m[2]) if (m := WORD_AND_MARK.fullmatch(c)) else (c, "") for c in chunks]
        self.others.need([[x for x, _ in split]], lambda new: self._library([" " + c for c in new]))
        others = self.others.now
        return [others[x] + self.ends[m] for x, m in split]

    def many(self, texts: list[str]) -> list:
        if not self.separable:
            return [self._one(e, self.counts) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if self.folds:
            return [x for _, part in chunks(texts) for x in self._folded(part)]
        join = sum if self.counts else b"".join
        wide = [WIDE_SPACE.search(t) is not None for t in texts]
        lines = [[] if w else [line.split(" ") for line in t.split("\n")] for t, w in zip(texts, wide, strict=True)]
        self.begins.need([[line[0] for line in own] for own in lines], self._library)
        self.words.need([line[1:] for own in lines for line in own], self._learn)
        begin, get = self.begins.now, self.words.now.__getitem__
        out = []
        for t, w, own in zip(texts, wide, lines, strict=True):
            if w:
                out.append(join(self._library(BEFORE_SPACE.split(t))))
            elif self.counts:
                out.append(sum(begin[line[0]] + sum(map(get, line[1:])) for line in own) + (len(own) - 1) * self.newline)
            else:
                out.append(self.newline.join(begin[line[0]] + b"".join(map(get, line[1:])) for line in own))
        return out


class Table:
    """Ids of words by the words' hashes. Beyond ``limit`` words it is begun anew."""

    def __init__(self, limit: int, dtype: np.dtype):
        self.limit, self.dtype = limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.begin, self.length, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def find(self, hashes: np.ndarray, encode) -> np.ndarray:
        """Places of sorted hashes; ``encode`` gives (lengths, all ids) of the numbers of those that are new."""
        if len(self.hashes) + len(hashes) > self.limit:
            self._clear()
        place = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[place] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if not len(new):
            return place
        length, ids = encode(new)
        self.hashes = np.insert(self.hashes, place[new], hashes[new])
        self.begin = np.insert(self.begin, place[new], len(self.ids) + np.cumsum(length) - length)
        self.length = np.insert(self.length, place[new], length)
        self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.hashes, hashes)


class Store:
    """What is known of chunks, in two generations: when the younger is full, it takes the place of the older."""

    def __init__(self, limit: int):
        self.now: dict = {}
        self.old: dict = {}
        self.limit = limit

    def need(self, lists: list[list[str]], encode) -> None:
        """Afterwards ``now`` has the chunks of all lists. ``encode`` gives the values of those that are in neither generation."""
        wanted = set().union(*lists)
        missing = wanted.difference(self.now)
        if not missing:
            return
        if len(self.now) + len(missing) > self.limit:
            self.now, self.old, missing = {}, self.now, wanted
        known = missing.intersection(self.old)
        self.now.update((c, self.old[c]) for c in known)
        if new := list(missing.difference(known)):
            self.now.update(zip(new, encode(new), strict=True))
