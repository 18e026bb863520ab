"""Byte-pair vocabularies as arrays, and the exact encoder over them.

The encoder keeps, for every prefix of a piece, the one token that ends its encoding. Tokens that end at a position come
from an automaton whose state is the longest suffix of the text read that begins a token; its output links list every
token that is a suffix. A candidate is the last token when it may follow the last token of the prefix before it, that is,
when merging the two byte strings by rank would not join bytes across their border. Exactly one candidate passes. Ids
follow from the back-pointers. All pieces of a batch advance together, one byte a step, in numpy.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np
import regex

PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From so few pieces on, those that are left are finished one by one.
FEW = 6
#: Bytes that an encoder's kept results take, about; what a result takes besides its letters and ids; and compared pairs of tokens
#: that are kept.
KEEP_BYTES, ENTRY_BYTES, KEEP_PAIRS = 32_000_000, 160, 200_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")


class IntMap:
    """Open addressing over int64 keys (not -1) with int32 values, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while todo.size:
            slot = (home[todo] + step) & self.mask
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]
            mine = free & (self.keys[slot] == keys[todo])
            self.values[slot[mine]] = values[todo[mine]]
            todo, step = todo[~mine], step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not there."""
        slot = self._home(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies in JSON write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


def _merge(ranks: dict[bytes, int], token: bytes) -> list[bytes]:
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = limit, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], limit)
            if r < best:
                best, at = r, i
        if at < 0:
            raise ValueError(f"token {limit} can't be reached by merges")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@cache
def load_vocab(path: str) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary file: ranks (``*.tiktoken``) or a byte-level BPE (``*.json``)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        ids = {raw(t): i for t, i in model["vocab"].items() if t in made or len(t) == 1}
        splits = [(ids[raw(a)], ids[raw(b)], ids[raw(a + b)]) for a, b in pairs]
    else:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        splits = [(*(ids[p] for p in _merge(ids, t)), i) for t, i in ids.items() if len(t) > 1]
    order = [c for _, _, c in splits]
    if not path.endswith(".json"):
        splits.sort(key=lambda s: s[2])
    elif order != sorted(order):
        raise ValueError("ids must rise with the merges' ranks")
    size = max(ids.values()) + 1
    left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
    for a, b, c in splits:
        left[c], right[c] = a, b
    tokens: list[bytes] = [b""] * size
    for t, i in ids.items():
        tokens[i] = t
    edges: dict[int, int] = {}
    token_of, depth, parent = [-1], [0], [(0, 0)]
    for t, i in ids.items():
        node = 0
        for byte in t:
            k = node << 8 | byte
            nxt = edges.get(k)
            if nxt is None:
                nxt = edges[k] = len(token_of)
                token_of.append(-1)
                depth.append(depth[node] + 1)
                parent.append((node, byte))
            node = nxt
        token_of[node] = i
    n = len(token_of)
    fail, out = [0] * n, [-1] * n
    for node in sorted(range(1, n), key=depth.__getitem__):
        up, byte = parent[node]
        if up:
            f = fail[up]
            while f and (f << 8 | byte) not in edges:
                f = fail[f]
            fail[node] = edges.get(f << 8 | byte, 0)
    nxt_out = [-1] * n
    for node in sorted(range(1, n), key=depth.__getitem__):
        nxt_out[node] = out[fail[node]]
        out[node] = node if token_of[node] >= 0 else nxt_out[node]
    data = b"".join(tokens)
    return {
        "left": left, "right": right, "fail": np.array(fail, np.int32), "out": np.array(out, np.int32), "next_out": np.array(nxt_out, np.int32),
        "token_of": np.array(token_of, np.int32), "depth": np.array(depth, np.int32), "edge_keys": np.fromiter(edges, np.int64, len(edges)),
        "edge_to": np.fromiter(edges.values(), np.int32, len(edges)), "pair_keys": np.array([a << 20 | b for a, b, _ in splits], np.int64),
        "pair_to": np.array([c for _, _, c in splits], np.int32), "bytes": np.frombuffer(data, np.uint8),
        "starts": np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64),
    }


class Encoder:
    """Exact byte-pair encoding. Results of chunks are kept; when they take ``keep`` bytes, all are let go."""

    def __init__(self, arrays: dict[str, np.ndarray], keep: int = KEEP_BYTES):
        self.a, self.keep, self.held = arrays, keep, 0
        self.edges, self.pairs = IntMap(arrays["edge_keys"], arrays["edge_to"]), IntMap(arrays["pair_keys"], arrays["pair_to"])
        root = np.zeros(256, np.int32)
        at_root = arrays["edge_keys"] < 256
        root[arrays["edge_keys"][at_root]] = arrays["edge_to"][at_root]
        self.root, self.size = root, len(arrays["left"])
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        self.split = regex.compile(PRE_TOKEN).findall
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}
        self.plain: dict[str, list | dict] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a: undoing merges from the latest on, no earlier merge joins across the border."""
        left, right = self.a["left"], self.a["right"]
        ok, idx = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 30, np.int32)
        while idx.size:
            joined = self.pairs.get(a.astype(np.int64) << 20 | b)
            bad = (joined >= 0) & (joined < limit)
            ok[idx[bad]] = False
            na, nb = right[a], left[b]
            end_a, end_b = na == a, nb == b
            later = a > b
            cut_a = ~end_a & (later | end_b)
            cut_b = ~end_b & (~later | end_a)
            limit = np.where(cut_a, a, np.where(cut_b, b + 1, limit))
            a, b = np.where(cut_a, na, a), np.where(cut_b, nb, b)
            go = ~bad & ~(end_a & end_b)
            idx, a, b, limit = idx[go], a[go], b[go], limit[go]
        return ok

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.empty(len(state), np.int32)
        todo, s = np.arange(len(state)), state
        while todo.size:
            b = byte[todo]
            nxt = self.edges.get(s.astype(np.int64) << 8 | b)
            at_root = s == 0
            nxt[at_root] = self.root[b[at_root]]
            done = (nxt >= 0) | at_root
            out[todo[done]] = nxt[done]
            todo, s = todo[~done], self.a["fail"][s[~done]]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's ids begin (one more than there are pieces)."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lens, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1][order]
        flat, sorted_lens = np.frombuffer(b"".join(pieces), np.uint8), lens[order]
        last = np.zeros(len(flat), np.int32)
        state = np.zeros(len(pieces), np.int32)
        out, next_out, token_of, depth = self.a["out"], self.a["next_out"], self.a["token_of"], self.a["depth"]
        longest = int(sorted_lens[0]) if len(pieces) else 0
        alive = np.searchsorted(-sorted_lens, -np.arange(longest), side="left")
        for i in range(longest):
            n = int(alive[i])
            if n <= FEW:
                for k in range(n):
                    a = int(starts[k])
                    self._finish(flat, last, a, i, a + int(sorted_lens[k]), int(state[k]))
                break
            here = starts[:n] + i
            s = state[:n] = self._step(state[:n], flat[here].astype(np.int64))
            todo, cand = np.arange(n), out[s]
            while todo.size:
                if (cand < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                t, before = token_of[cand], i + 1 - depth[cand]
                ok = before == 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self.compatible(last[starts[todo[rest]] + before[rest] - 1], t[rest])
                last[here[todo[ok]]] = t[ok]
                todo, cand = todo[~ok], next_out[cand[~ok]]
        width = np.diff(self.a["starts"])
        live = np.flatnonzero(sorted_lens > 0)
        at, found = sorted_lens[live] - 1, []
        while live.size:
            t = last[starts[live] + at]
            found.append((live, t))
            at = at - width[t]
            more = at >= 0
            live, at = live[more], at[more]
        count = np.zeros(len(pieces), np.int64)
        for idx, _ in found:
            count[idx] += 1
        by_piece = np.zeros(len(pieces), np.int64)
        by_piece[order] = count
        ends = np.concatenate([[0], np.cumsum(by_piece)])
        begin = ends[:-1][order]
        ids = np.zeros(int(ends[-1]), np.int32)
        for k, (idx, t) in enumerate(found):
            ids[begin[idx] + count[idx] - 1 - k] = t
        return ids, ends

    def _finish(self, flat: np.ndarray, last: np.ndarray, start: int, done: int, end: int, state: int) -> None:
        """The last tokens of one piece's prefixes from ``done`` bytes on, byte by byte: arrays pay only for many pieces."""
        if not self.plain:
            a = self.a
            lists = {k: a[k].tolist() for k in ("left", "right", "fail", "out", "next_out", "token_of", "depth")}
            self.plain = lists | {"edges": dict(zip(a["edge_keys"].tolist(), a["edge_to"].tolist())), "pairs": dict(zip(a["pair_keys"].tolist(), a["pair_to"].tolist())), "fit": {}}
        p = self.plain
        edges, fail, out, next_out, token_of, depth, fit = (p[k] for k in ("edges", "fail", "out", "next_out", "token_of", "depth", "fit"))
        if len(fit) > KEEP_PAIRS:
            fit.clear()
        ends = last[start : start + done].tolist()
        for byte in flat[start + done : end].tolist():
            nxt = edges.get(state << 8 | byte)
            while nxt is None and state:
                state = fail[state]
                nxt = edges.get(state << 8 | byte)
            state = nxt or 0
            node, size = out[state], len(ends) + 1
            while node >= 0:
                token, before = token_of[node], size - depth[node]
                if not before:
                    break
                pair = ends[before - 1] << 20 | token
                ok = fit.get(pair)
                if ok is None:
                    ok = fit[pair] = self._fits(ends[before - 1], token)
                if ok:
                    break
                node = next_out[node]
            if node < 0:
                raise ValueError("the vocabulary lacks a byte")
            ends.append(token)
        last[start:end] = ends

    def _fits(self, a: int, b: int) -> bool:
        """As ``compatible``, for one pair."""
        left, right, pairs, limit = self.plain["left"], self.plain["right"], self.plain["pairs"], 1 << 30
        while True:
            if pairs.get(a << 20 | b, limit) < limit:
                return False
            na, nb = right[a], left[b]
            if na == a and nb == b:
                return True
            if na != a and (a > b or nb == b):
                a, limit = na, a
            else:
                b, limit = nb, b + 1

    def _code(self, pieces: list[str]) -> list[bytes]:
        ids, ends = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        raw, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        cut = (ends * w).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, chunks: set[str], prefix: str, into: dict[str, bytes | None], border: bool) -> None:
        """Chunks of letters, with a mark after them or not, need no search for the pieces' borders.

        With ``border``, chunks that begin or end with white space get None: their text must be cut by ``_BORDER``.
        """
        words, ends, other = set(), [], []
        for c in chunks:
            if c.isalpha():
                words.add(c)
            elif c[-1:] in self.marks and (head := c[:-1]).isalpha():
                ends.append(c)
                if head not in into:
                    words.add(head)
            elif border and (not c or c[0].isspace() or c[-1].isspace()):
                into[c] = None if c or prefix else b""
            else:
                other.append(c)
        index: dict[str, int] = {}
        members = [[index.setdefault(p, len(index)) for p in self.split(prefix + c)] for c in other]
        listed = list(words)
        coded = self._code([prefix + w for w in listed] + list(index))
        into.update(zip(listed, coded))
        for c in ends:
            into[c] = into[c[:-1]] + self.marks[c[-1]]
        n = len(listed)
        for c, m in zip(other, members):
            into[c] = b"".join([coded[n + j] for j in m])

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes (two bytes an id if the vocabulary allows)."""
        if self.held > self.keep:
            self.first, self.rest, self.held = {}, {}, 0
        if not self.marks:
            self.marks = dict(zip(".,;:!?", self._code(list(".,;:!?"))))
        cut = [t.split(" ") for t in texts]
        heads = {c[0] for c in cut} - self.first.keys()
        tails = set().union(*cut) - self.rest.keys()
        for new, prefix, into in ((heads, "", self.first), (tails, " ", self.rest)):
            if new:
                self._learn(new, prefix, into, True)
                self.held += sum(ENTRY_BYTES + len(c) + len(into[c] or b"") for c in new)
        get, first, out = self.rest.__getitem__, self.first, []
        for t, c in zip(texts, cut):
            try:
                out.append(first[c[0]] + b"".join(map(get, c[1:])))
            except TypeError:
                c = _BORDER.split(t)
                a: dict[str, bytes | None] = {}
                b: dict[str, bytes | None] = {}
                self._learn({c[0]}, "", a, False)
                self._learn(set(c[1:]), " ", b, False)
                out.append(a[c[0]] + b"".join(map(b.__getitem__, c[1:])))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that a row of ids stands for."""
        starts = self.a["starts"]
        ids = ids.astype(np.int64)
        begin, width = starts[ids], np.diff(starts)[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(width)
        pos = np.arange(int(ends[-1])) + np.repeat(begin - (ends - width), width)
        return self.a["bytes"][pos].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(key: str, arrays: dict[str, np.ndarray]) -> Encoder:
    """The encoder of this Python worker for a vocabulary; made once a worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(arrays)
    return _ENCODERS[key]
