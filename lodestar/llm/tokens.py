"""Token ids of many texts with the ``tokenizers`` library, each distinct word encoded once.

The byte-level BPE splits a text into pre-tokens and merges inside each of them
only. A batch is therefore cut where a pre-token surely begins, equal pieces are
found by hash and compared byte by byte, and the library encodes only pieces that this
worker has not met or has forgotten. Ids are those of ``encode(text,
add_special_tokens=False)`` on the whole text, added tokens that stand in it included.
A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .textbytes import segment_hashes

END_ID = 0
_SPACE, _NEWLINE, _LATIN1_LEAD = 32, 10, 0xC3
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ",.;:!?"]] = True
#: Longer pieces (no blank for that long) are encoded anew each time.
_KEEP_BYTES = 128
#: New pieces that the library gets as one text, a line each.
_LINES = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins whatever stands around: at a document's
    start; at one blank or newline between visible characters (and after such a
    newline); at a stop after an ASCII letter. Visible: printable ASCII or
    U+00C0 to U+00FF, so no kind of space."""
    n = len(buf)
    at = np.zeros(n + 1, bool)
    if n:
        before = np.zeros(n, bool)
        before[1:] = _GRAPH[buf[:-1]]
        before[2:] |= (buf[1:-1] >= 0x80) & (buf[1:-1] < 0xC0) & (buf[:-2] == _LATIN1_LEAD)
        after = np.zeros(n, bool)
        after[:-1] = _GRAPH[buf[1:]] | (buf[1:] == _LATIN1_LEAD)
        edge = offs[(offs > 0) & (offs < n)]
        before[edge] = False
        after[edge - 1] = False
        gap = before & after
        line = gap & (buf == _NEWLINE)
        at[:-1] = line | (gap & (buf == _SPACE))
        at[1:] |= line
        at[1:-1] |= _LETTER[buf[:-1]] & _STOP[buf[1:]]
        at[offs] = True
    return np.flatnonzero(at[:n])


def _plain(buf: np.ndarray) -> np.ndarray:
    """Bytes of visible characters as in ``piece_starts``."""
    plain = _GRAPH[buf]
    lead = np.flatnonzero((buf[:-1] == _LATIN1_LEAD) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0))
    plain[lead] = plain[lead + 1] = True
    return plain


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all elements of the segments, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _by_piece(spec: dict) -> bool:
    """Whether the tokenizer splits as ``piece_starts`` says, and no added token could
    stand across a cut."""
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        return False
    added = spec.get("added_tokens") or []
    return not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or re.search(r"\s|[A-Za-z][,.;:!?]", t["content"]) for t in added)


class TokenEncoder:
    """Keeps the ids of the pieces met so far, at most ``max_pieces``, then forgets those
    that came only once."""

    def __init__(self, path: str, max_pieces: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab_size = self.lib.get_vocab_size()
        self.max_pieces = max_pieces
        self.by_piece = _by_piece(json.loads(self.lib.to_str()))
        line = self.lib.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.by_piece and len(line) == 1 else None
        self.slot: dict[int, int] = {}
        self.n = 0
        self.start, self.length, self.spot, self.span, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(5))
        self.key = np.zeros(1 << 16, np.uint64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.text, self.told = np.zeros(1 << 18, np.uint8), 0

    def _forget(self) -> None:
        live = np.fromiter(self.slot.values(), np.int64, len(self.slot))
        live = live[self.hits[live] > 1]
        live = live[np.argsort(-self.hits[live], kind="stable")][: self.max_pieces // 2]
        ids, text = self.ids[_spread(self.start[live], self.length[live])], self.text[_spread(self.spot[live], self.span[live])]
        self.n, self.used, self.told = len(live), len(ids), len(text)
        self.ids[: self.used], self.text[: self.told] = ids, text
        for name in ("length", "span", "key"):
            own = getattr(self, name)
            own[: self.n] = own[live]
        self.start[: self.n] = np.cumsum(self.length[: self.n]) - self.length[: self.n]
        self.spot[: self.n] = np.cumsum(self.span[: self.n]) - self.span[: self.n]
        self.hits[:] = 0
        self.slot = dict(zip(self.key[: self.n].tolist(), range(self.n), strict=True))

    def _room(self, pieces: int, ids: int, text: int) -> None:
        while self.n + pieces > len(self.start):
            for name in ("start", "length", "spot", "span", "hits", "key"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.zeros_like(own)]))
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.told + text > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])

    def _add(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Encodes pieces; ``plain`` ones (visible characters, perhaps after one blank) end
        where a line ends, whatever stands around, so many are one text for the library."""
        raw = buf.tobytes()
        lines, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        cut = [raw[i : i + n] for i, n in zip(start[lines].tolist(), size[lines].tolist(), strict=True)]
        texts = [b"\n".join([*cut[i : i + _LINES], b""]).decode() for i in range(0, len(cut), _LINES)]
        got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        ends = flat == self.line if len(lines) else np.zeros(len(flat), bool)
        at = np.flatnonzero(ends)
        sizes = np.diff(np.append(-1, at)) - 1
        other = [e.ids for e in self.lib.encode_batch_fast([raw[i : i + n].decode("utf-8", "replace") for i, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)], add_special_tokens=False)]
        ids = np.concatenate([flat[~ends], np.fromiter(chain.from_iterable(other), np.uint32, sum(map(len, other)))])
        order = np.concatenate([lines, rest])
        text = buf[_spread(start[order], size[order])]
        self._room(len(order), len(ids), len(text))
        new = np.arange(self.n, self.n + len(order))
        self.length[new] = np.append(sizes, np.fromiter(map(len, other), np.int64, len(other)))
        self.start[new] = self.used + np.cumsum(self.length[new]) - self.length[new]
        self.span[new] = size[order]
        self.spot[new] = self.told + np.cumsum(self.span[new]) - self.span[new]
        self.hits[new] = 0
        self.ids[self.used : self.used + len(ids)] = ids
        self.text[self.told : self.told + len(text)] = text
        self.n, self.used, self.told = self.n + len(order), self.used + len(ids), self.told + len(text)
        out = np.empty(len(order), np.int64)
        out[order] = new
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and the bounds (n + 1) of each text's ids."""
        if self.n > self.max_pieces:
            self._forget()
        docs = len(offs) - 1
        starts = piece_starts(buf, offs) if self.by_piece else np.unique(offs[:-1][np.diff(offs) > 0])
        sizes = np.diff(np.append(starts, len(buf)))
        hashes = segment_hashes(buf, starts, starts + sizes)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        # pieces are the whole buffer, one after another
        if (sizes != sizes[first][which]).any() or (buf != buf[_spread(starts[first][which], sizes)]).any():
            # other bytes with the same hash: every piece on its own, none kept
            first = which = np.arange(len(starts))
            slots = np.full(len(starts), -1)
            keep = np.zeros(len(starts), bool)
        else:
            get = self.slot.get
            slots = np.fromiter((get(k, -1) for k in hashes[first].tolist()), np.int64, len(first))
            met = np.flatnonzero(slots >= 0)
            same = self.span[slots[met]] == sizes[first[met]]
            size = np.where(same, sizes[first[met]], 0)
            differs = buf[_spread(starts[first[met]], size)] != self.text[_spread(self.spot[slots[met]], size)]
            same[np.repeat(np.arange(len(met)), size)[differs]] = False
            keep = sizes[first] <= _KEEP_BYTES
            keep[met[~same]] = False
            slots[met[~same]] = -1
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            a, size = starts[first[missing]], sizes[first[missing]]
            seen = np.append(0, np.cumsum(_plain(buf)))
            body = size - (buf[a] == _SPACE)
            plain = (seen[a + size] - seen[a] == body) & (body > 0) & (self.line is not None)
            slots[missing] = self._add(buf, a, size, plain)
            kept = missing[keep[missing]]
            self.key[slots[kept]] = hashes[first[kept]]
            self.slot.update(zip(hashes[first[kept]].tolist(), slots[kept].tolist(), strict=True))
        self.hits[slots] += 1
        piece = slots[which]
        size = self.length[piece]
        ids = self.ids[_spread(self.start[piece], size)]
        bounds = np.append(0, np.cumsum(size))[np.searchsorted(starts, offs)]
        if end_id is None:
            return ids, bounds
        bounds = bounds + np.arange(docs + 1)
        out = np.full(len(ids) + docs, end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[bounds[1:] - 1] = False
        out[own] = ids
        return out, bounds


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """This worker's encoder; workers live on between tasks."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]
