"""Token ids of whole texts, from a public tokenizer file.

The tokenizer drops white space, no token spans it, and a run of letters never
shares a token with closing punctuation after it.  So the ids of a text are
those of its *units* -- blank-separated words, less the closing punctuation,
which is a unit of its own -- one after another.  A task encodes each distinct
unit with the tokenizers library once, keeps up to ``KEPT_UNITS`` of them, and
gathers the ids of a chunk of texts with array operations.  Units are known by
their bytes (two 64-bit words and the length); longer ones, and those that may
hold a special token, are looked up as byte strings.
"""

from __future__ import annotations

import os
import re

import numpy as np

from revel.llm import arrays as A

END_ID = 1
KEPT_UNITS = 400_000
CHUNK_BYTES = 2 << 20

CLOSING = A.table(b".,;:!?|")
ASCII_LETTER = A.table(bytes([*range(65, 91), *range(97, 123)]))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLAIN = re.compile(rb"[a-z]+")

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, at)``: document i has units ``at[i] .. at[i+1]``."""
    ws, we, wat = A.words(buf, off)
    core = np.where(CLOSING[buf], -1, np.arange(len(buf), dtype=np.int32))
    np.maximum.accumulate(core, out=core)
    last = core[we - 1] if len(we) else np.zeros(0, np.int32)
    two = (last >= ws) & (last < we - 1)
    two[two] = ASCII_LETTER[buf[last[two]]]
    place = np.arange(len(ws)) + A.bounds(two)[:-1]
    start = np.empty(len(ws) + int(two.sum()), np.int64)
    end = np.empty_like(start)
    start[place], end[place] = ws, we
    end[place[two]] = start[place[two] + 1] = last[two] + 1
    end[place[two] + 1] = we[two]
    return start, end, np.concatenate([place, [len(start)]])[wat]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.named: dict[bytes, int] = {}
        self.known = np.zeros((4, 0), np.uint64)  # hash, first and second eight bytes, length: sorted by hash
        self.code = np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, found: list[bytes]) -> np.ndarray:
        """Encode new units; their codes."""
        model, ids = self.tokenizer.model, []
        for w in found:
            if _PLAIN.fullmatch(w):
                ids.append([t.id for t in model.tokenize(w.decode())])
            else:
                ids.append(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
        codes = len(self.at) - 1 + np.arange(len(found))
        self.flat = np.concatenate([self.flat, np.array([x for i in ids for x in i], np.uint32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(i) for i in ids], dtype=np.int64)])
        return codes

    def _named(self, found: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.named]
        self.named.update(zip(new, self._add(new).tolist()))
        return np.array([self.named[w] for w in found], np.int64)

    def _codes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = buf.tobytes()
        size = end - start
        long = size > 16
        # in any case: units are lower-cased below, and only the raw text tells a special token from its likeness
        lowered = raw.lower()
        special = any(s in lowered for s in self.specials)
        if special:
            odd = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(buf == ord("<"), out=odd[1:])
            long |= odd[end] > odd[start]
        low = np.zeros(len(buf) + 24, np.uint8)
        low[:len(buf)] = A.LOWER[buf]
        eight = np.ndarray((len(buf) + 16,), np.uint64, low, strides=(1,))
        out = np.empty(len(start), np.int64)
        short = np.flatnonzero(~long)
        s, n = start[short], size[short]
        first = eight[s] & _MASK[np.minimum(n, 8)]
        second = eight[s + 8] & _MASK[np.clip(n - 8, 0, 8)]
        h = A.mix(A.mix(second + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + first)
        key = np.stack([h, first, second, n.astype(np.uint64)])
        order = np.argsort(h, kind="stable")
        key = key[:, order]
        new_key = A.distinct(key[0])
        same = np.flatnonzero(~new_key)
        clash = (key[1:, same] != key[1:, same - 1]).any(axis=0) if len(same) else np.zeros(0, bool)
        rep = key[:, new_key]
        place = np.minimum(np.searchsorted(self.known[0], rep[0]), max(0, len(self.code) - 1))
        found = self.known[0, place] == rep[0] if len(self.code) else np.zeros(rep.shape[1], bool)
        if clash.any() or (found.any() and (self.known[1:, place[found]] != rep[1:, found]).any()):
            # two different units with one hash: look all of them up as byte strings
            out[:] = self._named([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
            return out
        codes = np.empty(rep.shape[1], np.int64)
        codes[found] = self.code[place[found]]
        if (~found).any():
            at = s[order[new_key][~found]]
            lower = low.tobytes()
            codes[~found] = self._add([lower[a:b] for a, b in zip(at.tolist(), (at + rep[3, ~found].astype(np.int64)).tolist())])
            by = np.searchsorted(self.known[0], rep[0, ~found])
            self.known = np.insert(self.known, by, rep[:, ~found], axis=1)
            self.code = np.insert(self.code, by, codes[~found])
        out[short[order]] = codes[np.cumsum(new_key) - 1]
        rest = np.flatnonzero(long)
        if len(rest):
            out[rest] = self._named([raw[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())])
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of each text, with ``end_id`` after its tokens."""
        if len(self.at) > KEPT_UNITS:
            self.reset()
        start, end, unit_at = units(buf, off)
        codes = self._codes(buf, start, end) if len(start) else np.zeros(0, np.int64)
        size = self.at[codes + 1] - self.at[codes]
        ids = self.flat[A.ragged(self.at[codes], size)]
        at = A.bounds(size)[unit_at]
        if end_id is None:
            return ids, at
        n = len(off) - 1
        ends = at[1:] + np.arange(n)
        out = np.empty(len(ids) + n, np.uint32)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body], out[ends] = ids, end_id
        return out, at + np.arange(n + 1)


def encoder(path: str) -> Encoder:
    """The task's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop the encoders a task of another stage has left in this worker."""
    _encoders.clear()
