"""Byte-level BPE encoding of whole texts inside tasks.

The tokenizers library encodes; a memo of bounded size saves it from merging the same part
again. Texts of plain characters (Latin letters, ASCII digits and punctuation, single spaces
and line feeds) are divided as the vocabulary's own published pattern does it: where the class of
the bytes changes. Parts of a group of texts that are not known go through the library's BPE model
in one call, told apart by line feeds. The memo is found by hash and compared by the part's whole
bytes, so only parts of up to 16 bytes are kept. A text with any other character or with other runs of
white space than line feeds is encoded whole by the library.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from loadstone.llm.common import mix, spread_ranges

MEMO_ENTRIES = 1_000_000
RECENT_ENTRIES = 1 << 16
KEY_BYTES = 16
_STRANGE = re.compile(r"[^\x00-~À-ÖØ-öø-ÿ]")
_LETTER, _DIGIT, _MARK, _SPACE, _BREAK, _END, _OTHER = range(7)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_classes() -> np.ndarray:
    """Class of each byte; what is not ASCII is a byte of a Latin letter."""
    out = np.full(256, _LETTER, np.uint8)
    out[:128] = [_DIGIT if 48 <= b < 58 else _LETTER if chr(b).isalpha() else _MARK if 32 < b < 127 else _OTHER for b in range(128)]
    out[[32, 10, 0]] = _SPACE, _BREAK, _END
    return out


_CLASS = _byte_classes()


def _shown_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


def _part_starts(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the parts of zero-ended texts begin; every end is a part of its own.

    ``raw`` and ``kind`` go on for two bytes after the last end.
    """
    before = np.concatenate([[_END], kind[:-1]]).astype(np.uint8)
    after = np.append(kind[1:], _END)
    start = (kind != before) & (before != _SPACE)
    start |= (kind == _SPACE) | (kind == _END)
    start |= (kind == _BREAK) & (after <= _MARK)  # the last of a run stands alone before a word
    at = np.flatnonzero(start[:-2] & (raw[:-2] == ord("'")))
    one, two = raw[at + 1], raw[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return np.flatnonzero(start[:-2])


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in a table sorted by hash."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table["hash"], key["hash"]), len(table) - 1)
    met = table[at]
    return at, (met["hash"] == key["hash"]) & (met["low"] == key["low"]) & (met["high"] == key["high"])


_ENTRY = np.dtype([("hash", np.uint64), ("low", np.uint64), ("high", np.uint64), ("at", np.int64), ("n", np.int64)])


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, one bytes object a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = _shown_bytes()
        self.merger = Tokenizer(self.tokenizer.model)  # of parts in printable characters, a line feed between them
        self.merger.pre_tokenizer = Split(self.shown[10], "isolated")
        self.line_feed = self.tokenizer.token_to_id(self.shown[10])
        self._forget()

    def _forget(self) -> None:
        self.tables = [np.zeros(0, _ENTRY), np.zeros(0, _ENTRY)]  # all but the latest entries, and those; each sorted by hash
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of all entries

    def _keep(self, entries: np.ndarray, ids: np.ndarray) -> None:
        """``entries`` say where their ids begin in ``ids``."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        entries["at"] += self.used
        self.used += len(ids)
        old, recent = self.tables
        recent = np.concatenate([recent, entries])
        if len(recent) > RECENT_ENTRIES:
            old, recent = np.concatenate([old, recent]), recent[:0]
            old = old[np.argsort(old["hash"], kind="stable")]
        self.tables = [old, recent[np.argsort(recent["hash"], kind="stable")]]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after another, and how many each has."""
        feeds = [k for k, p in enumerate(parts) if p[:1] == b"\n"]
        line = b"\n".join([p for p in parts if p[:1] != b"\n"]).decode("latin-1").translate(self.shown)
        ids = np.array(self.merger.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        between = ids == self.line_feed
        ends = np.append(np.flatnonzero(between), len(ids)) if len(parts) > len(feeds) else np.zeros(0, np.int64)
        n = np.diff(ends, prepend=-1) - 1
        ids = ids[~between]
        if feeds:  # a few distinct runs of line feeds
            own = [[t.id for t in self.tokenizer.model.tokenize(parts[k].decode().translate(self.shown))] for k in feeds]
            whole = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
            for k, x in zip(feeds, own):
                whole.insert(k, np.array(x, np.uint32))
            ids, n = np.concatenate(whole), np.array([len(x) for x in whole])
        if len(n) != len(parts):
            raise ValueError("a part's ids hold a line feed")
        return ids, n

    def _known(self, key: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, number) of distinct keys; ``parts`` gives the bytes of those at some places."""
        begin, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        there = np.zeros(len(key), bool)
        for table in self.tables:
            at, found = _find(table, key)
            begin[found], n[found] = table["at"][at[found]], table["n"][at[found]]
            there |= found
        ids = self.pool[spread_ranges(begin[there], n[there])]
        begin[there] = np.cumsum(n[there]) - n[there]
        new = np.flatnonzero(~there)
        if len(new):
            fresh, n[new] = self._merged(parts(new))
            begin[new] = np.cumsum(n[new]) - n[new]
            entries = np.zeros(len(new), _ENTRY)
            for c in ("hash", "low", "high"):
                entries[c] = key[c][new]
            entries["at"], entries["n"] = begin[new], n[new]
            self._keep(entries, fresh)
            begin[new] += len(ids)
            ids = np.concatenate([ids, fresh])
        return ids, begin, n

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if sum(map(len, self.tables)) > MEMO_ENTRIES:
            self._forget()
        plain = [i for i, t in enumerate(texts) if "\0" not in t and not any(x in t for x in self.special) and (t.isascii() or not _STRANGE.search(t))]
        if plain:
            for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain])):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, ids in zip(rest, self._library([texts[i] for i in rest])):
                out[i] = ids
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes | None]:
        """None for texts whose characters or white space are for the library."""
        data = "\0".join(texts).encode() + bytes(3)
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        start = _part_starts(raw, kind)
        size = np.diff(start, append=len(raw) - 2)
        text_ends = np.flatnonzero(kind[:-2] == _END)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(text_ends, np.flatnonzero((kind[:-1] == _OTHER) | (kind[:-1] == _SPACE) & (kind[1:] > _MARK)))] = True

        eight = np.ndarray((len(raw),), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from every place on
        low, high = eight[start] & _LOW_BYTES[np.minimum(size, 8)], np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = eight[start[more] + 8] & _LOW_BYTES[np.minimum(size[more] - 8, 8)]
        hashes = mix(low ^ mix(high + np.uint64(0x9E3779B97F4A7C15)))
        of = np.searchsorted(text_ends, start)
        whole = (kind[start] != _END) & ~odd[of]
        kept = whole & (size <= KEY_BYTES)
        _, first, same = np.unique(hashes[kept], return_index=True, return_inverse=True)
        at = np.flatnonzero(kept)
        head = at[first]
        key = np.zeros(len(head), _ENTRY)
        key["hash"], key["low"], key["high"] = hashes[head], low[head], high[head]
        odd[of[at[(low[head][same] != low[at]) | (high[head][same] != high[at])]]] = True  # two parts of one hash
        ids, begin, n = self._known(key, lambda new: [data[a:z] for a, z in zip(start[head[new]].tolist(), (start + size)[head[new]].tolist())])

        begins, counts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        begins[at], counts[at] = begin[same], n[same]
        wide = np.flatnonzero(whole & (size > KEY_BYTES))  # merged once a group
        if len(wide):
            wide_parts = [data[a:z] for a, z in zip(start[wide].tolist(), (start + size)[wide].tolist())]
            distinct = list(dict.fromkeys(wide_parts))
            wide_ids, wide_n = self._merged(distinct)
            place = {p: k for k, p in enumerate(distinct)}
            which = np.array([place[p] for p in wide_parts])
            begins[wide], counts[wide] = (len(ids) + np.cumsum(wide_n) - wide_n)[which], wide_n[which]
            ids = np.concatenate([ids, wide_ids])
        flat = ids[spread_ranges(begins, counts)].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(counts)[np.flatnonzero(kind[start] == _END)]) * 4
        return [None if strange else flat[a:z] for strange, a, z in zip(odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_groups(col: pa.Array, chars: int = 1 << 20):
    """(first row, texts) of about ``chars`` characters each; null is empty."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(col):
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= chars:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
