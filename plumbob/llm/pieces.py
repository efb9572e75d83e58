"""Operator 9 - SentencePiece encoding and decoding by a max-plus scan.

The model is a BPE vocabulary of SentencePiece, read as data; its segmentation
is computed here.  A sequence of pieces is the BPE segmentation of a text if
and only if each two neighbours are *compatible*, that is, BPE leaves the two
as they are when it segments their concatenation: a merge across a border
would be the first one to break it, and everything that decides on that merge
lies within the two pieces.  So segmentation is a best path through the
lattice of pieces whose arcs weigh 0 (compatible) or minus infinity, and that
path is unique: for each position there is one last piece.

Long texts are split into chunks of ``CHUNK`` characters, at any place.  The
state at a border is the piece that covers the character before it; both
chunks list the same possible states from the characters around the border.
Each chunk gives a transfer matrix of path weights from its entry states to
its exit states; the matrices of a text are combined by max-plus products in
a parallel prefix scan, which fixes each border's state, and then each chunk is
backtraced by itself.  Matrices take a few hundred numbers; texts travel once.

Within a chunk, positions that no piece of the vocabulary can span (before a
word, beside an unknown character) have one state, so a chunk is its first and
last word fragment and words between.  Those are whole by themselves; new ones are
segmented many at a time by vectorised merges and kept in a memo of ``MEMO``
words.  A text without such positions is one long fragment and
works the same.

As SentencePiece does, spaces become U+2581, a leading one is added, and
characters without a piece become byte pieces; an empty text has no pieces.
Null texts have null ids.  Rows, repeated or with null ids, are kept; columns
other than ``doc_id`` and ``text``, whatever their names, aren't passed on; an
empty table gives no rows.  A model that isn't BPE is an error.  Decoding
restores every text but for U+2581 itself, which becomes a space.
"""

from __future__ import annotations

import pickle
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import list_array, require, slices, table, trim, tuned

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
#: Words, and pairs of pieces, that a worker remembers at most.
MEMO = 120_000
#: Words of so many characters are segmented one by one; others so many at once.
LONG, SEGMENTED = 64, 16384
NEVER = 2**31 - 1
ABSENT = -(1 << 31)
SPACE = "▁"
LOW = -np.inf


def _bpe(s: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """SentencePiece's merges of a short string and the last of them."""
    parts, last = list(s), None
    while True:
        best, at = LOW, -1
        for i in range(len(parts) - 1):
            v = score.get(parts[i] + parts[i + 1])
            if v is not None and v > best:
                best, at = v, i
        if at < 0:
            return parts, last
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Vocabulary:
    """A BPE model's pieces; built on the driver and sent to the tasks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unknown = n, sp.unk_id()
        self.byte = {}
        self.score = {}
        self.ids = {}
        self.bytes = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        if any(x != int(x) for x in self.score.values()):
            raise ValueError(f"{path} isn't a BPE model: merges have whole numbers as scores")
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # longest piece of each two first characters
        for p in self.ids:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Pieces in the order of their merges; those that BPE can't build aren't used.
        order = sorted(self.ids, key=lambda p: (-self.score[p], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.split = {}
        for p in order:
            parts, last = _bpe(p, self.score)
            if len(parts) == 1:
                self.split[p] = last
        self.usable = {p: self.ids[p] for p in self.split}
        # Merges as arrays: (left, right) symbols to priority and merged symbol.
        # A symbol is a piece's id, or from n on a character that isn't a piece.
        symbol = dict(self.ids)
        for c in sorted(set(chain.from_iterable(self.ids)) - symbol.keys()):
            symbol[c] = n + len(symbol) - len(self.ids)
        self.symbols = n + len(symbol) - len(self.ids)
        tier = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        merges = sorted((symbol[p[:k]] * self.symbols + symbol[p[k:]], tier[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.merge_key, self.merge_tier, self.merge_to = (np.array(x, kind) for x, kind in zip(zip(*merges), (np.int64, np.int32, np.int32))) if merges else (np.zeros(0, k) for k in (np.int64, np.int32, np.int32))
        self.chars = {c: i for c, i in symbol.items() if len(c) == 1}
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.append(0, np.cumsum([len(b) for b in self.bytes])).astype(np.int64)
        scores = list(self.score.values())
        self.tied = len(set(scores)) < len(scores)
        self.key = f"{path}:{n}:{hash(tuple(order[:100]))}"


class Table:
    """Memo of words after a space: word to the number of its ids' row."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.used = 0

    def add(self, bodies: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        rows, end = len(self.rows), self.used + len(flat)
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < rows + len(bodies) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : end] = flat
        self.starts[rows + 1 : rows + len(bodies) + 1] = self.used + np.cumsum(sizes)
        self.used = end
        self.rows.update(zip(bodies, range(rows, rows + len(bodies))))


def gather(starts: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a ragged array end to end, and their sizes."""
    begin = starts[rows]
    size = starts[rows + 1] - begin
    end = np.cumsum(size)
    return flat[np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


class Segmenter:
    """Segmentation by a vocabulary; keeps memos."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.table = Table()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in v.chars.items():
            self.symbol[ord(c)] = i

    # ------------------------------------------------------------ the lattice

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as two pieces."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if len(self.pairs) > MEMO // 4:
            self.pairs.clear()
        ok = self.pairs[a, b] = self._compatible(a, b)
        return ok

    def _compatible(self, a: str, b: str) -> bool:
        v = self.v
        if a not in v.split or b not in v.split or a[-1] + b[0] not in v.inner:
            return True
        if v.tied and SPACE * 2 in a + b:
            return _bpe(a + b, v.score)[0] == [a, b]
        # Undo the merges of both, latest first: at each time the pieces beside
        # the border mustn't merge before what they became did.
        rank, split = v.rank, v.split
        x, y, limit = a, b, 1 << 60
        while True:
            r = rank.get(x + y)
            if r is not None and r < limit:
                return False
            sx, sy = split[x], split[y]
            if sx is None and sy is None:
                return True
            rx, ry = rank[x] if sx else -1, rank[y] if sy else -1
            # The left one's last merge comes before the border's at equal rank.
            if rx > ry:
                limit, x = rx, sx[1]
            else:
                limit, y = ry + 1, sy[0]

    def sure(self, a: str, b: str) -> bool:
        """Whether no piece has these characters side by side."""
        return a + b not in self.v.inner

    def emit(self, piece: str) -> tuple[int, ...]:
        i = self.v.usable.get(piece)
        if i is not None:
            return (i,)
        if not self.v.byte:
            return (self.v.unknown,)
        return tuple(self.v.byte[x] for x in piece.encode("utf-8", "replace"))

    def piece(self, s: str) -> bool:
        """A piece, or one character that isn't any."""
        return s in self.v.usable or len(s) == 1

    def path(self, s: str, first: str | None = None, last: str | None = None) -> list[str]:
        """The pieces of ``s`` after the piece ``first``, the last being ``last``
        (if given).

        The lattice's single path of weight 0, searched depth first, long pieces
        before short ones.  A beginning has one last piece, so a position that
        leads nowhere needn't be tried again.
        """
        if last is not None:
            return self._to(s, first, last)
        n, usable, reach, pairs = len(s), self.v.usable, self.v.reach, self.pairs
        out, dead = [], set()
        at, prev, size = 0, first, reach.get(s[:2], 1)
        while at < n:
            size = min(size, n - at)
            while size:
                x = s[at : at + size]
                if (size == 1 or x in usable) and at + size not in dead:
                    if prev is None:
                        break
                    ok = pairs.get((prev, x))
                    if ok is None:
                        ok = self.compatible(prev, x)
                    if ok:
                        break
                size -= 1
            if size:
                out.append(x)
                prev = x
                at += size
                size = reach.get(s[at : at + 2], 1)
            else:
                dead.add(at)
                size = len(out.pop())
                at -= size
                size -= 1
                prev = out[-1] if out else first
        return out

    def _to(self, s: str, first: str | None, last: str) -> list[str]:
        """Like ``path``; here several last pieces of a beginning may be
        possible, as the text goes on beyond it."""
        nodes: list[dict[str, str | None]] = [{} for _ in range(len(s) + 1)]
        for t in range(1, len(s) + 1):
            for b in range(max(0, t - self.v.longest), t):
                x = s[b:t]
                if not self.piece(x):
                    continue
                if not b:
                    if first is None or self.compatible(first, x):
                        nodes[t][x] = None
                else:
                    for p in nodes[b]:
                        if self.compatible(p, x):
                            nodes[t][x] = p
                            break
        out, t, x = [], len(s), last
        while x is not None:
            out.append(x)
            x, t = nodes[t][x], t - len(x)
        return out[::-1]

    # ------------------------------------------------------------ words, texts

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of a string with sure positions at both ends, by the lattice."""
        cuts = [0, *(k for k in range(1, len(w)) if self.sure(w[k - 1], w[k])), len(w)]
        return tuple(i for a, b in zip(cuts, cuts[1:]) for p in self.path(w[a:b]) for i in self.emit(p))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols among the merges; -1 where there is none."""
        v = self.v
        key = a.astype(np.int64) * v.symbols + b
        at = np.minimum(np.searchsorted(v.merge_key, key), len(v.merge_key) - 1)
        return np.where((a >= 0) & (b >= 0) & (v.merge_key[at] == key), at, -1)

    def _tiers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._merge(a, b)
        return np.where(at >= 0, self.v.merge_tier[at], NEVER)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words, end to end, and their numbers.

        All words take their best merge (the leftmost of equal ones) at the same
        time, one after another; that is the words' best path.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        known = self.symbol[code]
        symbol = np.where(known >= 0, known, -1 - code).astype(np.int32)
        order = np.argsort(size, kind="stable")
        out_symbol, out_word = [], []
        for lo in range(0, len(words), SEGMENTED):
            own = order[lo : lo + SEGMENTED]
            n, width = size[own].copy(), max(1, int(size[own].max()))
            place = np.arange(width)
            m = np.full((len(own), width + 1), ABSENT, np.int32)
            inside = place < n[:, None]
            m[:, :width][inside] = symbol[(begin[own][:, None] + place)[inside]]
            tier = np.full((len(own), width), NEVER, np.int32)
            if len(self.v.merge_key):
                tier = self._tiers(m[:, :-1], m[:, 1:]).astype(np.int32)
            while len(own):
                best = tier.argmin(1)
                row = np.arange(len(own))
                live = tier[row, best] < NEVER
                if not live.all():
                    done = ~live
                    keep = np.arange(m.shape[1]) < n[done][:, None]
                    out_symbol.append(m[done][keep])
                    out_word.append(np.repeat(own[done], n[done]))
                    own, n, m, tier, best = own[live], n[live], m[live], tier[live], best[live]
                    if not len(own):
                        break
                    width = int(n.max())
                    m, tier = m[:, : width + 1], tier[:, :width]
                    row = np.arange(len(own))
                m[row, best] = self.v.merge_to[self._merge(m[row, best], m[row, best + 1])]
                place = np.arange(m.shape[1], dtype=np.int32)
                m = np.take_along_axis(m, np.minimum(place + (place > best[:, None]), m.shape[1] - 1), 1)
                m[:, -1] = ABSENT
                n -= 1
                place = np.arange(tier.shape[1])
                tier = np.take_along_axis(tier, np.minimum(place + (place >= best[:, None]), tier.shape[1] - 1), 1)
                tier[:, -1] = NEVER
                tier[row, best] = self._tiers(m[row, best], m[row, best + 1])
                left = np.maximum(best - 1, 0)
                tier[row, left] = np.where(best > 0, self._tiers(m[row, left], m[row, left + 1]), tier[row, left])
        found, word = np.concatenate(out_symbol), np.concatenate(out_word)
        back = np.argsort(word, kind="stable")
        found, word = found[back], word[back]
        odd = np.flatnonzero((found < 0) | (found >= self.v.size))
        if len(odd):
            letter = {i: c for c, i in self.v.chars.items()}
            kinds, which = np.unique(found[odd], return_inverse=True)
            ids = [self.emit(letter[x] if x >= 0 else chr(-1 - x)) for x in kinds.tolist()]
            count = np.ones(len(found), np.int64)
            count[odd] = np.array([len(x) for x in ids])[which]
            first = np.cumsum(count) - count
            wide = np.repeat(found, count)
            for k, x in enumerate(ids):
                for j, i in enumerate(x):
                    wide[first[odd[which == k]] + j] = i
            found, word = wide, np.repeat(word, count)
        return found.astype(np.int32), np.bincount(word, minlength=len(words))

    def lookup(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space, end to end, and their numbers."""
        if len(self.table.rows) > MEMO:
            self.table = Table()
        table = self.table
        new = list(set(bodies).difference(table.rows))
        short = [w for w in new if len(w) < LONG]
        if short:
            table.add(short, *self.segment([SPACE + w for w in short]))
        for w in new:
            if len(w) >= LONG:
                ids = self.word(SPACE + w)
                table.add([w], np.array(ids, np.int32), np.array([len(ids)]))
        rows = np.fromiter(map(table.rows.__getitem__, bodies), np.int64, len(bodies))
        return gather(table.starts, table.flat, rows)

    def words(self, s: str) -> np.ndarray:
        """Ids of a string that begins and ends at sure positions; spaces are
        U+2581 already."""
        if not s:
            return np.zeros(0, np.int32)
        head, _, rest = s.partition(SPACE)
        parts = [np.array(self.word(head), np.int32)] if head else []
        if _:
            bodies = rest.split(SPACE)
            if all(bodies):
                parts.append(self.lookup(bodies)[0])
            else:  # runs of spaces belong to the word after them
                at, n, s = 0, len(rest) + 1, SPACE + rest
                while at < n:
                    end = at
                    while end < n and s[end] == SPACE:
                        end += 1
                    end = s.find(SPACE, end)
                    end = n if end < 0 else end
                    w = s[at:end]
                    parts.append(np.array(self.word(w), np.int32) if w[1:2] == SPACE or len(w) == 1 else self.lookup([w[1:]])[0])
                    at = end
        return np.concatenate(parts)

    def encode(self, text: str) -> array:
        """Ids of a whole text that is one chunk."""
        return array("i", self.encode_all([text])[0].tolist())

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are one chunk each, end to end, and their numbers."""
        plain = [k for k, t in enumerate(texts) if t and not ("  " in t or SPACE in t or t[0] == " " or t[-1] == " ")]
        split = [texts[k].split(" ") for k in plain]
        flat, size = self.lookup(list(chain.from_iterable(split)))
        sizes = np.zeros(len(texts), np.int64)
        if split:
            sizes[plain] = np.add.reduceat(size, np.cumsum([0, *map(len, split[:-1])]))
        if len(plain) == sum(1 for t in texts if t):
            return flat, sizes
        ends = np.concatenate([[0], np.cumsum(sizes)])
        parts, one = [], set(plain)
        for k, t in enumerate(texts):
            if k in one:
                parts.append(flat[ends[k] : ends[k + 1]])
            elif t:
                parts.append(self.words(normal(t)))
                sizes[k] = len(parts[-1])
        return np.concatenate(parts), sizes

    # ------------------------------------------------------------ chunks

    def states(self, s: str, at: int) -> list[tuple[int, str]]:
        """Possible states at position ``at`` of ``s``: (end, piece)."""
        m = self.v.longest
        out = []
        for b in range(max(0, at - m), at):
            for e in range(at, min(len(s), b + m) + 1):
                if e - b == 1 or s[b:e] in self.v.usable:
                    out.append((e, s[b:e]))
        return out

    def _cuts(self, s: str, p: int, q: int) -> tuple[int, int]:
        """First and last sure position in (p, q], or -1."""
        first = next((k for k in range(p + 1, q + 1) if k < len(s) and self.sure(s[k - 1], s[k])), -1)
        if first < 0:
            return -1, -1
        return first, next(k for k in range(q, p, -1) if k < len(s) and self.sure(s[k - 1], s[k]))

    def _reach(self, s: str, entry: list[tuple[int, str | None]], stop: int) -> dict[tuple[int, str], int]:
        """Pieces that begin before ``stop`` and end there or later, each with a
        bit for each entry state that a path of weight 0 leads from."""
        nodes: dict[int, dict[str | None, int]] = defaultdict(dict)
        out: dict[tuple[int, str], int] = {}
        for i, (e, x) in enumerate(entry):
            if e >= stop:
                out[e, x] = out.get((e, x), 0) | 1 << i
            else:
                nodes[e][x] = nodes[e].get(x, 0) | 1 << i
        for t in range(min(nodes, default=stop), stop):
            if t not in nodes:
                continue
            here = nodes.pop(t)
            for e in range(t + 1, min(len(s), t + self.v.longest) + 1):
                y = s[t:e]
                if not self.piece(y):
                    continue
                bits = 0
                for x, mask in here.items():
                    if x is None or self.compatible(x, y):
                        bits |= mask
                if bits:
                    if e >= stop:
                        out[e, y] = out.get((e, y), 0) | bits
                    else:
                        nodes[e][y] = nodes[e].get(y, 0) | bits
        return out

    def transfer(self, s: str, p: int, q: int, first: bool, last: bool) -> np.ndarray:
        """The max-plus transfer matrix of ``s[p:q]``; ``s`` has the characters
        around."""
        entry = [(p, None)] if first else self.states(s, p)
        leave = [(e, x) for e, x in self.states(s, q) if not last or e == q]
        m = np.full((len(entry), len(leave)), LOW)
        a, b = self._cuts(s, p, q)
        if a < 0 or a == q:
            reached = self._reach(s, entry, q)
            for j, state in enumerate(leave):
                for i in range(len(entry)):
                    if reached.get(state, 0) >> i & 1:
                        m[i, j] = 0
            return m
        bits = 0
        for (e, _), mask in self._reach(s, entry, a).items():
            if e == a:
                bits |= mask
        head = np.where([bits >> i & 1 for i in range(len(entry))], 0.0, LOW)
        if b == q:
            ends = self._reach(s, [(self._before(s, p, q), None)], q)
            tail = np.array([0.0 if e == q and (e, x) in ends else LOW for e, x in leave])
        else:
            ends = self._reach(s, [(b, None)], q)
            tail = np.array([0.0 if state in ends else LOW for state in leave])
        return head[:, None] + tail

    def _before(self, s: str, p: int, q: int) -> int:
        """The last sure position before ``q``; there is one after ``p``."""
        return next(k for k in range(q - 1, p, -1) if self.sure(s[k - 1], s[k]))

    def backtrace(self, s: str, p: int, q: int, first: bool, last: bool, i: int, j: int) -> array:
        """Ids of the pieces that begin in ``s[p:q]`` between two known states."""
        e, x = (p, None) if first else self.states(s, p)[i]
        end, y = [(b, z) for b, z in self.states(s, q) if not last or b == q][j]
        out = array("i")
        if e >= q:  # one piece covers all
            return out
        a, b = self._cuts(s, p, q)
        if a < 0 or a == q:
            out.extend(k for z in self.path(s[e:end], x, y) for k in self.emit(z))
            return out
        out.extend(k for z in self.path(s[e:a], x) for k in self.emit(z))
        if b == q and end == q:
            out.frombytes(self.words(s[a:q]).tobytes())
            return out
        out.frombytes(self.words(s[a:b]).tobytes())
        out.extend(k for z in self.path(s[b:end], None, y) for k in self.emit(z))
        return out


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None]).max(1)


def scan(ms: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairs (associative, log depth)."""
    if len(ms) == 1:
        return ms
    pairs = [max_plus(ms[k], ms[k + 1]) for k in range(0, len(ms) - 1, 2)]
    done = scan(pairs)
    return [ms[0], *(done[k // 2] if k % 2 else max_plus(done[k // 2 - 1], ms[k]) for k in range(1, len(ms)))]


def borders(ms: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the best path."""
    prefix = scan(ms)
    j = int(prefix[-1][0].argmax())
    out = []
    for k in range(len(ms) - 1, -1, -1):
        i = int((prefix[k - 1][0] + ms[k][:, j]).argmax()) if k else 0
        out.append((i, j))
        j = i
    return out[::-1]


_segmenters: dict[str, Segmenter] = {}


class Sent:
    """A vocabulary on its way to the tasks: pickled, so that a process unpacks
    it once however many jobs send it."""

    def __init__(self, spark: SparkSession, path: str):
        v = Vocabulary(path)
        self.key, self.packed = v.key, spark.sparkContext.broadcast(pickle.dumps(v))

    def segmenter(self) -> Segmenter:
        """This process's segmenter; its memos outlive a task."""
        if self.key not in _segmenters:
            _segmenters[self.key] = Segmenter(pickle.loads(self.packed.value))
        return _segmenters[self.key]

    @property
    def vocabulary(self) -> Vocabulary:
        return self.segmenter().v


def encode_by_chunks(text: str, seg: Segmenter, chunk: int = CHUNK) -> array:
    """What the distributed plan does, in one process."""
    s = normal(text)
    cuts = list(range(0, len(s), chunk)) + [len(s)]
    spans = [(p, q, p == 0, q == len(s)) for p, q in zip(cuts, cuts[1:])]
    out = array("i")
    for (p, q, f, t), (i, j) in zip(spans, borders([seg.transfer(s, *x) for x in spans])):
        out.extend(seg.backtrace(s, p, q, f, t, i, j))
    return out


def decode_bytes(ids: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts, end to end, and each one's first byte and the last's end;
    the added space is still there."""
    data, size = gather(v.starts, v.flat, ids)
    return data, np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))]


def decode_ids(ids, v: Vocabulary) -> str:
    data = decode_bytes(np.asarray(ids, np.int64), np.array([len(ids)]), v)[0].tobytes()
    return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")


CHUNKS = {"key": pa.string(), "no": pa.int32(), "s": pa.string(), "p": pa.int32(), "q": pa.int32(), "head": pa.bool_(), "tail": pa.bool_()}


def ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{c} {names[k]}" for c, k in kinds.items())


def columns(kinds: dict[str, pa.DataType], values) -> pa.RecordBatch:
    """A batch of these columns; a value is an Arrow array or a sequence."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(values, kinds.values())], list(kinds))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, token_ids, n_tokens, restored)``, a row for each input row;
    ``restored`` says that decoding gives the text."""
    require(docs, "doc_id", "text")
    spark = tuned(docs.sparkSession)
    sent = Sent(spark, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, token_ids array<int>, n_tokens int, restored boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = sent.segmenter()
        v = seg.v
        for b in batches:
            if not b.num_rows:
                continue
            # a null text counts as empty
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
            for i, j in slices(offsets):
                part = b.slice(i, j - i)
                texts = part.column("text").to_pylist()
                null = np.array([t is None for t in texts])
                ids, sizes = seg.encode_all(texts)
                data, ends = decode_bytes(ids, sizes, v)
                data = data.tobytes()
                same = [t is None or data[a + 1 : e] == t.replace(SPACE, " ").encode() for t, a, e in zip(texts, ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes.astype(np.int32), mask=null), pa.array(np.array(same), mask=null)], ["doc_id", "token_ids", "n_tokens", "restored"])
        trim()

    short = rows.where(F.col("text").isNull() | (F.length("text") < chunk)).mapInArrow(whole, schema)
    giants = rows.where(F.length("text") >= chunk).withColumn("key", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = sent.vocabulary.longest + 1
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                s, out = normal(text), []
                for k, p in enumerate(range(0, len(s), chunk)):
                    q = min(len(s), p + chunk)
                    lo = max(0, p - around)
                    out.append((key, k, s[lo : q + around], p - lo, q - lo, p == 0, q == len(s)))
                yield columns(CHUNKS, zip(*out))

    chunks = giants.select("key", "text").dropDuplicates(["key"]).mapInArrow(cut, ddl(CHUNKS))
    matrix = {"key": pa.string(), "no": pa.int32(), "rows": pa.int32(), "m": pa.binary()}
    state = {"key": pa.string(), "no": pa.int32(), "i": pa.int32(), "j": pa.int32()}
    traced = {"key": pa.string(), "no": pa.int32(), "ids": pa.list_(pa.int32())}

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = sent.segmenter()
        for b in batches:
            ms = [seg.transfer(*x) for x in zip(*(b.column(c).to_pylist() for c in ("s", "p", "q", "head", "tail")))]
            yield columns(matrix, [b.column("key"), b.column("no"), [len(m) for m in ms], [(m == 0).astype(np.uint8).tobytes() for m in ms]])

    def fix(group: pa.Table) -> pa.Table:
        group = group.sort_by("no").combine_chunks()
        ms = [np.where(np.frombuffer(m, np.uint8).reshape(n, -1), 0.0, LOW) for n, m in zip(group["rows"].to_pylist(), group["m"].to_pylist())]
        i, j = zip(*borders(ms))
        return pa.table({"key": group["key"], "no": group["no"], "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = sent.segmenter()
        for b in batches:
            ids = [np.frombuffer(seg.backtrace(*x), np.int32) for x in zip(*(b.column(c).to_pylist() for c in ("s", "p", "q", "head", "tail", "i", "j")))]
            yield columns(traced, [b.column("key"), b.column("no"), list_array(ids, pa.int32())])
        trim()

    known = chunks.mapInArrow(matrices, ddl(matrix)).groupBy("key").applyInArrow(fix, ddl(state))
    parts = chunks.join(known, ["key", "no"]).mapInArrow(trace, ddl(traced))
    ids = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts")).select("key", F.flatten(F.col("parts.ids")).alias("token_ids"))

    @F.arrow_udf("boolean")
    def restored(ids: pa.Array, texts: pa.Array) -> pa.Array:
        v, at, flat = sent.vocabulary, ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        return pa.array([decode_ids(flat[a:e], v) == t.replace(SPACE, " ") for a, e, t in zip(at, at[1:], texts.to_pylist())], pa.bool_())

    long = giants.join(ids, "key").select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), restored("token_ids", "text").alias("restored"))
    return short.unionByName(long)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, token_ids)``; null ids give null."""
    require(encoded, "doc_id", "token_ids")
    spark = tuned(encoded.sparkSession)
    sent = Sent(spark, model)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        v, at, flat = sent.vocabulary, ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        return pa.array([decode_ids(flat[a:e], v) if x.is_valid else None for a, e, x in zip(at, at[1:], ids)], pa.string())

    return encoded.select("doc_id", run("token_ids").alias("text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
