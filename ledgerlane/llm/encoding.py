"""Token ids by the tokenizers library, encoding each distinct stretch of text once per worker.

Between a visible character and a following ASCII blank every word of the tokenizer ends, whatever
surrounds it.  So a text is the row of its units (blanks and the visible characters behind them) and its
ids are those of its units, which the library encodes.  With the usual words of byte-level tokenizers a
unit also ends between an ASCII letter or digit and an ASCII mark ("end" and "." are two), since runs of
letters, of digits and of marks never share a word there.  Where a text has other white space than
blanks, tabs and line ends, runs could span a unit's edge: the library then gets the whole text.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain, repeat

BLANKS = " \t\n\r"
PLAIN = string.ascii_letters + string.digits
TOGETHER = 16  # new units encoded as one string: a call has its own cost
TOGETHER_CHARACTERS = 4 << 20  # of texts whose units are told apart in one pass
OTHER_BLANKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def byte_lengths(library):
    """Bytes of text behind each token id of a byte-level tokenizer, whose ids cover a text byte by byte; None for others."""
    import numpy as np
    from tokenizers import pre_tokenizers

    kind = library.pre_tokenizer
    if not isinstance(kind, pre_tokenizers.ByteLevel) or kind.add_prefix_space or library.normalizer is not None:
        return None
    vocabulary = library.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token)  # one character stands for one byte
    for i, token in library.get_added_tokens_decoder().items():
        sizes[i] = len(token.content.encode())
    return sizes


def bytes_of(characters: str):
    """A table of bytes, true for these ASCII characters."""
    import numpy as np

    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


def ending_marks(library):
    """A table of the ASCII marks before which a word of letters or digits ends in any text; None where the words are not
    those of the byte-level pattern, or an added token looks at what surrounds it."""
    added = library.get_added_tokens_decoder().values()
    if byte_lengths(library) is None or not library.pre_tokenizer.use_regex or any(t.single_word or t.lstrip or t.rstrip for t in added):
        return None
    inside = {b for t in added for a, b in zip(t.content, t.content[1:]) if a in PLAIN}  # an added token stays in one piece
    return bytes_of("".join(m for m in string.punctuation if m not in inside))


def cut(strings: list[str], marks=None):
    """(units of all strings in a row as an Arrow array, the number of units before each string and in all); ``marks`` is
    the table of ``ending_marks``."""
    import numpy as np
    import pyarrow as pa

    _, offsets, data = pa.array(strings, pa.large_string()).buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1)
    byte = np.frombuffer(data, np.uint8, at[-1]) if at[-1] else np.zeros(0, np.uint8)
    blank = (byte == 32) | (byte == 9) | (byte == 10) | (byte == 13)
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    if marks is not None:
        marked = np.flatnonzero(marks[byte[1:]]) + 1
        begins[marked[bytes_of(PLAIN)[byte[marked - 1]]]] = True
    begins[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(begins)
    edges = np.append(begins, at[-1]).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges), data if at[-1] else pa.py_buffer(b""))
    return units, np.searchsorted(begins, at)


def listed(strings) -> list[str]:
    """An Arrow array of strings as a list, several times faster than ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    KEPT = 6_000_000  # characters of units remembered; beyond it those met in one call only are forgotten

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.sizes, self.marks = byte_lengths(self.library), ending_marks(self.library)
        self.forget()

    def forget(self):
        import numpy as np

        self.known, self.held = {}, 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # units met in a later call than that which brought them

    def thin(self):
        """Forgets the units not met again, or all if the others alone take over half the room."""
        import numpy as np

        kept = np.flatnonzero(self.again)
        words = list(self.known)  # in the order of their numbers
        words = [words[i] for i in kept.tolist()]
        held = sum(map(len, words))
        if 2 * held > self.KEPT:
            self.forget()
            return
        self.known, self.held = dict(zip(words, range(len(words)))), held
        starts, self.lengths = self.starts[kept], self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.ids[np.repeat(starts - self.starts, self.lengths) + np.arange(self.lengths.sum())]
        self.again = np.zeros(len(kept), bool)

    def by_library(self, strings: list[str]):
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def each(self, units: list[str]):
        """(ids of all units in a row, how many each has)."""
        import numpy as np

        got = self.by_library(units)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())), lengths

    def joined(self, units: list[str], sizes=None):
        """As ``each``, for units that words end between in any order (all begin with a blank and end visibly, or all begin
        with an ending mark and end with an ASCII letter or digit): encoded some at a time and told apart by the bytes
        that their ids cover; ``sizes`` are the units' bytes, where known."""
        import numpy as np

        if self.sizes is None or not units:
            return self.each(units)
        ids, _ = self.each(["".join(units[a:a + TOGETHER]) for a in range(0, len(units), TOGETHER)])
        covered = np.cumsum(self.sizes[ids])
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)) if sizes is None else sizes)
        last = np.minimum(np.searchsorted(covered, ends), len(ids) - 1)
        if covered[-1] != ends[-1] or (covered[last] != ends).any():
            return self.each(units)
        return ids, np.diff(last, prepend=-1)

    def learn(self, units):
        """Encodes and numbers the units of an Arrow array, not met before and each given once."""
        import numpy as np

        if not len(units):
            return
        _, offsets, data = units.buffers()
        at, byte = np.frombuffer(offsets, np.int64)[units.offset:units.offset + len(units) + 1], np.frombuffer(data, np.uint8)
        sizes, first, last, blank = np.diff(at), byte[at[:-1]], byte[at[1:] - 1], bytes_of(BLANKS)
        framed = blank[first] & ~blank[last]
        marked = np.zeros(len(units), bool) if self.marks is None else self.marks[first] & bytes_of(PLAIN)[last]
        new = listed(units)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        starts, lengths = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        for together, which in ((True, framed), (True, marked), (False, ~framed & ~marked)):
            which = np.flatnonzero(which)
            some = [new[i] for i in which.tolist()]
            ids, n = self.joined(some, sizes[which]) if together else self.each(some)
            starts[which], lengths[which] = len(self.ids) + np.cumsum(n) - n, n
            self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.held += sum(map(len, new))

    def numbered(self, units):
        """The numbers of an Arrow array of units: each distinct one of them is looked up once."""
        import numpy as np
        import pyarrow as pa

        coded = units.dictionary_encode()
        words = listed(coded.dictionary)
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        number[new] = len(self.known) + np.arange(len(new))
        self.learn(coded.dictionary.take(pa.array(new)))
        return number[coded.indices.to_numpy()]

    def encode(self, strings: list[str]):
        """(ids of all strings in a row, their edges)."""
        import numpy as np

        parts, sizes, pending = [], [], []

        def flush():
            if not pending:
                return
            if self.held > self.KEPT:
                self.thin()
            units, edges = cut(pending, self.marks)
            index = self.numbered(units)
            lengths = self.lengths[index]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            parts.append(self.ids[np.repeat(self.starts[index] - ends[:-1], lengths) + np.arange(ends[-1])])
            sizes.extend(np.diff(ends[edges]).tolist())
            pending.clear()

        held = 0
        for s in strings:
            whole = OTHER_BLANKS.search(s) is not None
            if whole or held > TOGETHER_CHARACTERS:
                flush()
                held = 0
            if whole:
                ids = np.array(self.by_library([s])[0], np.int32)
                parts.append(ids)
                sizes.append(len(ids))
                continue
            pending.append(s)
            held += len(s)
        flush()
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.cumsum([0] + sizes)


def shared_encoder(holder: dict) -> Encoder:
    """The worker's encoder; ``holder`` is the value of a broadcast, which a worker keeps."""
    if "encoder" not in holder:
        holder["encoder"] = Encoder(holder["path"])
    return holder["encoder"]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1
