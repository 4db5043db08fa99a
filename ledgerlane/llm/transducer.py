"""Byte-level BPE as a deterministic transducer whose transitions carry emitted-token counts.

A state is what may still change the tokens of a text read so far: the kind of the open word and, for
that word, the weighted set ``{(pending bytes, token before them, tokens up to there)}`` of token starts
that a later byte could complete.  It is the subset construction with residual weights; a transition
carries the change of the token count as if the text ended there.  States are made when first met and kept.

A token may follow another one only if the two, merged alone, stay these two; so the last token of every
prefix is found from the last tokens of shorter prefixes, and the count of a text is the sum of its
transitions.
"""

from __future__ import annotations

import json

# kinds of characters the word splitter tells apart
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE = range(6)
# fixed values of the tokenizer's word pattern: endings that split off after an apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = r"\p{White_Space}"
SYNC = (9, 10, 13, 32)  # after a visible ASCII character, each of these starts a word from any state


def byte_alphabet() -> dict[str, int]:
    """Characters by which the file writes bytes: printable Latin-1 as itself, the rest from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Plain tables of a tokenizer file, to be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    to_bytes = lambda s: bytes(alphabet[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    added = [t["content"] for t in spec["added_tokens"]]
    return {
        "vocab": [to_bytes(t) for t in spec["model"]["vocab"] if t not in added],
        "merges": [(to_bytes(a), to_bytes(b)) for a, b in merges],
        "added": sorted(added, key=lambda t: (-len(t), t)),
    }


class Transducer:
    LIMIT = 800_000  # transitions kept; beyond it all are forgotten and made anew

    def __init__(self, spec: dict):
        import numpy as np
        import regex

        self.vocab = set(spec["vocab"])
        self.rank = {pair: i for i, pair in enumerate(spec["merges"])}
        self.prefixes = {t[:i] for t in self.vocab for i in range(1, len(t))}
        self.fits: dict = {}
        kinds = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (f"{WHITE_SPACE}+", BLANK)):
            for m in regex.finditer(pattern, every):
                kinds[m.start():m.end()] = kind
        kinds[ord(" ")], kinds[ord("'")] = SPACE, QUOTE
        self.kinds = kinds.tobytes()
        self.reset()

    def reset(self):
        import numpy as np

        self.ids: dict = {}
        self.states: list = []
        self.bits, self.used = 18, 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.out = np.zeros(1 << self.bits, np.int32)
        self.start = self.number(("B",))

    def number(self, state) -> int:
        n = self.ids.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    # tokens of one word

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, last: bytes, token: bytes) -> bool:
        got = self.fits.get((last, token))
        if got is None:
            if len(self.fits) > self.LIMIT:
                self.fits.clear()
            got = self.fits[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return got

    NOTHING = ((b"", b"", 0),)

    def extend(self, word: tuple, data: bytes) -> tuple[tuple, int]:
        """The open word with ``data`` behind it, and how many tokens that adds."""
        added = 0
        for i in range(len(data)):
            b, kept = data[i:i + 1], []
            for pending, last, n in word:
                token = pending + b
                if token in self.vocab and self.may_follow(last, token):
                    ends, count = token, n + 1
                if token in self.prefixes:
                    kept.append((token, last, n))
            word = (*((p, t, n - count) for p, t, n in kept), (b"", ends, 0))
            added += count
        return word, added

    # one character

    def fresh(self, kind: int, c: str, data: bytes) -> tuple[tuple, int]:
        word, n = self.extend(self.NOTHING, data)
        if kind == BLANK:
            return ("W", word, 0, False), n
        return {LETTER: ("L", word), NUMBER: ("N", word), OTHER: ("P", word), SPACE: ("S", word), QUOTE: ("A", word)}[kind], n

    def move(self, state: tuple, code: int) -> tuple[tuple, int]:
        c, kind = chr(code), self.kinds[code]
        data = c.encode("utf-8", "replace")
        mode = state[0]
        runs = {"L": (LETTER,), "N": (NUMBER,), "P": (OTHER, QUOTE), "S": (LETTER, NUMBER, OTHER, QUOTE)}
        if mode == "A":  # an apostrophe at the start of a word
            if c in ENDINGS:
                _, n = self.extend(state[1], data)
                return ("B",), n
            if any(len(e) == 2 and e[0] == c for e in ENDINGS):
                word, n = self.extend(self.NOTHING, data)
                return ("E", word, c), n
            if kind in runs["P"]:
                word, n = self.extend(state[1], data)
                return ("P", word), n
            return self.fresh(kind, c, data)
        if mode == "E":  # an apostrophe and the first of two letters
            if state[2] + c in ENDINGS:
                whole = len(self.merged(b"'" + (state[2] + c).encode()))
                return ("B",), whole - 1 - len(self.merged(state[2].encode()))
            state, mode = ("L", state[1]), "L"
        if mode in runs and kind in runs[mode]:
            word, n = self.extend(state[1], data)
            return ({LETTER: "L", NUMBER: "N"}.get(kind, "P"), word), n
        if mode in ("S", "W") and kind in (SPACE, BLANK):
            word, n = self.extend(state[1], data)
            return ("W", word, len(self.merged(data)) - n, kind == SPACE), n
        if mode == "W":  # all but the last blank are one word; a last space goes to what follows
            if not state[3]:
                after, n = self.fresh(kind, c, data)
                return after, state[2] + n
            single, _ = self.extend(self.NOTHING, b" ")
            after, n = self.move(("S", single), code)
            return after, state[2] + n
        return self.fresh(kind, c, data)

    # many characters at once

    def slot(self, key: int) -> int:
        mask = (1 << self.bits) - 1
        h = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[h] != key and self.keys[h] != -1:
            h = (h + 1) & mask
        return h

    def learn(self, key: int) -> int:
        """The slot of a transition, made now if it is new."""
        h = self.slot(key)
        if self.keys[h] == key:
            return h
        if self.used * 2 > len(self.keys):
            self.grow()
            h = self.slot(key)
        after, n = self.move(self.states[key >> 21], key & 0x1FFFFF)
        self.keys[h], self.next[h], self.out[h] = key, self.number(after), n
        self.used += 1
        return h

    def grow(self):
        import numpy as np

        old = [(k, n, o) for k, n, o in zip(self.keys.tolist(), self.next.tolist(), self.out.tolist()) if k != -1]
        self.bits += 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.out = np.zeros(1 << self.bits, np.int32)
        for k, n, o in old:
            h = self.slot(k)
            self.keys[h], self.next[h], self.out[h] = k, n, o

    def run(self, codes, starts, ends):
        """Token counts of the lanes ``codes[start:end]``, each read from the start state."""
        import numpy as np

        if self.used > self.LIMIT:
            self.reset()
        total = np.zeros(len(starts), np.int64)
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, left = starts[order].astype(np.int64), length[order]
        state, count = np.full(len(order), self.start, np.int64), np.zeros(len(order), np.int64)
        lanes, step = len(order), 0
        while lanes:
            lanes = int(np.searchsorted(-left[:lanes], -step, side="left"))
            if not lanes:
                break
            if lanes < 8 and left[0] - step > 2000:  # a few very long lanes: one after the other
                for i in range(lanes):
                    s, n = int(state[i]), 0
                    for c in codes[at[i] + step:at[i] + left[i]].tolist():
                        h = self.learn(s << 21 | c)
                        s, n = int(self.next[h]), n + int(self.out[h])
                    count[i] += n
                break
            key = state[:lanes] << 21 | codes[at[:lanes] + step].astype(np.int64)
            h = self.find(key)
            state[:lanes] = self.next[h]
            count[:lanes] += self.out[h]
            step += 1
        total[order] = count
        return total

    def find(self, key):
        import numpy as np

        h = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        miss = np.flatnonzero(self.keys[h] != key)
        mask = (1 << self.bits) - 1
        for _ in range(64):
            if not len(miss):
                return h
            h[miss] = (h[miss] + 1) & mask
            found = self.keys[h[miss]]
            if (new := found == -1).any():
                break
            miss = miss[found != key[miss]]
        if len(miss):
            bits = self.bits
            slots = {k: self.learn(k) for k in np.unique(key[miss]).tolist()}
            if self.bits != bits:
                return self.find(key)
            h[miss] = [slots[k] for k in key[miss].tolist()]
        return h

    # chunks of a text

    LANE = 160

    def sync_points(self, codes):
        """Places where a word starts whatever came before: a blank behind a visible ASCII character."""
        import numpy as np

        here, before = codes[1:], codes[:-1]
        blank = (here == 32) | (here == 10) | (here == 13) | (here == 9)
        return np.flatnonzero(blank & (before > 32) & (before < 127)) + 1

    def totals(self, strings: list[str]) -> list[int]:
        """Tokens of each whole string: lanes start at sync points, so their counts add up."""
        import numpy as np

        codes = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        if not len(codes):
            return [0] * len(strings)
        sync = self.sync_points(codes)
        _, first = np.unique(sync // self.LANE, return_index=True)
        starts = np.unique(np.concatenate([edges[:-1], sync[first]]))
        starts = starts[starts < len(codes)]
        counts = self.run(codes, starts, np.append(starts[1:], len(codes)))
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(starts, edges)
        return (sums[at[1:]] - sums[at[:-1]]).tolist()

    def chunk_map(self, chunk: str) -> tuple[bool, str, int, str]:
        """What a chunk does to any state: (resolved, head, count, tail).

        Up to its first sync point (head) the effect depends on the state before; from there to the
        last one it is a fixed count; the tail's words may go on in the next chunk.  A chunk without
        sync point is not resolved: it is all head.
        """
        import numpy as np

        codes = np.frombuffer(chunk.encode("utf-32-le", "replace"), np.uint32)
        sync = self.sync_points(codes)
        if not len(sync):
            return False, chunk, 0, ""
        a, b = int(sync[0]), int(sync[-1])
        return True, chunk[:a], self.totals([chunk[a:b]])[0], chunk[b:]

    def compose(self, a, b):
        """The map of two neighbouring chunks: associative."""
        if not a[0] and not b[0]:
            return False, a[1] + b[1], 0, ""
        if not a[0]:
            return True, a[1] + b[1], b[2], b[3]
        if not b[0]:
            return True, a[1], a[2], a[3] + b[1]
        return True, a[1], a[2] + b[2] + self.totals([a[3] + b[1]])[0], b[3]

    def scan(self, maps: list) -> int:
        """Tokens of a text from the maps of its chunks, composed pairwise as in a prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        _, head, count, tail = maps[0]
        return sum(self.totals([head, tail])) + count
