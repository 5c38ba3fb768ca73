"""A subword vocabulary as plain tables, and the two lattice recursions over it.

The vocabulary file is read on the driver; executors get the tables (their
size is fixed by the file, tens of thousands of pieces). Texts are prepared as
the model does it: spaces become U+2581 and one is put in front.

A piece of the vocabularies supported never holds U+2581 after another
character, and some marks never stand in a piece with letters, so every path
of a lattice has a boundary there: the lattice falls apart into segments, and
a segment's result can be kept for its next occurrence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

SPACE = "▁"
#: Segments up to this many characters are remembered; longer ones rarely come back.
MEMO_CHARS = 40
#: A generation of remembered segments.
MEMO_SIZE = 250_000
#: The search counts log probabilities in units of one nat by this.
UNITS = 1 << 24
#: A byte of a character outside a vocabulary of log probabilities scores this much below its lowest piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """``ids``: piece to id; ``log_probs`` by id (natural); ``bytes_of`` by id; ``byte_ids``: the fallback's 256 ids or empty; ``byte``: log probability of a fallback byte."""

    ids: dict[str, int]
    log_probs: list[float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    byte: float
    longest: int

    def __post_init__(self):
        self.prefixes = prefixes(self.ids, -1)
        # whole numbers add up alike wherever a search begins, so that ties are the same in a stream and in its parts
        self.scores = [round(x * UNITS) for x in self.log_probs]
        self.byte_score = round(self.byte * UNITS)
        marks = "".join(map(re.escape, sorted(marks_apart(self.ids))))
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{marks}]+|{SPACE}*[{marks}]+|{SPACE}+").findall
        self.memo = Memory()

    def __reduce__(self):  # what can be made anew isn't sent
        return Vocabulary, (self.ids, self.log_probs, self.bytes_of, self.byte_ids, self.unknown_id, self.byte, self.longest)

    def table(self) -> dict[str, float]:
        """Log probabilities of the pieces, with their beginnings marked 1.0."""
        return prefixes({p: self.log_probs[i] for p, i in self.ids.items()}, 1.0)


def prefixes(table: dict, mark) -> dict:
    """``table`` with all beginnings of its keys, which get ``mark`` where they are no keys."""
    return {k[:i]: mark for k in table for i in range(1, len(k))} | table


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a model file of the sentencepiece library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids, scores, raw, byte_ids = {}, [], [], [0] * 256
    n_bytes = 0
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        scores.append(sp.get_score(i))
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
            n_bytes += 1
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"" if not sp.is_unknown(i) else " ⁇ ".encode())
        else:
            ids[piece] = i
            raw.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("pieces that go on after a space are not supported")
    log_probs, byte = probabilities(ids, scores)
    return Vocabulary(ids, log_probs, raw, byte_ids if n_bytes == 256 else [], sp.unk_id(), byte, max(map(len, ids)))


def probabilities(ids: dict[str, int], scores: list[float], shift: float = 2.7) -> tuple[list[float], float]:
    """Natural log probabilities by id and of a fallback byte, from the vocabulary's scores.

    Scores that are log probabilities (their exponentials sum to about one)
    are taken as they are. A merge vocabulary's scores are negative ranks:
    they become Zipf-Mandelbrot probabilities 1 / (rank + shift), normalised
    over all pieces and the fallback bytes, each of which has the rank after
    the last piece. Pieces without a rank are like these bytes.
    """
    kept = [s for i in ids.values() if (s := scores[i]) > -1e8]
    out = list(scores)
    if 0.5 < sum(math.exp(min(0.0, s)) for s in kept) < 1.5 and min(kept) > -100:
        return out, min(kept) - UNKNOWN_PENALTY
    last = 1 - min(kept)
    for i in ids.values():
        out[i] = 1 / (shift + (last if scores[i] <= -1e8 else -scores[i]))
    byte = 1 / (shift + last)
    z = math.log(sum(out[i] for i in ids.values()) + 256 * byte)
    for i in ids.values():
        out[i] = math.log(out[i]) - z
    return out, math.log(byte) - z


def marks_apart(pieces: Iterable[str]) -> set[str]:
    """Characters other than letters and digits 0 to 9 whose pieces hold, after spaces, only such characters."""
    bare = [set(p.lstrip(SPACE)) for p in pieces]
    apart = {c for b in bare for c in b if not c.isalpha() and c not in "0123456789"} | {"\n"}
    while mixed := {c for b in bare if b & apart and not b <= apart for c in b & apart}:
        apart -= mixed
    return apart - {SPACE}


def segments(v: Vocabulary, text: str) -> list[str]:
    """The prepared text in parts between which every path has a boundary. The empty text has none."""
    return v.segment(SPACE + text.replace(" ", SPACE)) if text else []


_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*").findall


def units(text: str) -> list[str]:
    """The prepared text cut before each run of spaces: every segment lies within one unit. The empty text has none."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " ":
        return _UNIT(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE)).split(" ")


def best_path(v: Vocabulary, s: str) -> tuple[int, ...]:
    """Ids of the most probable segmentation of ``s``: as ``Encoder`` finds it, which a text within one window doesn't need."""
    if len(s) > v.longest:
        found = Encoder(v)
        return tuple(found.feed(s) + found.finish())
    get, scores, byte, n = v.prefixes.get, v.scores, v.byte_score, len(s)
    best, back, pick = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0
    for j in range(n):
        a, i = best[j], j + 1
        k = get(s[j:i])
        if k is None or k < 0:
            if (x := a + byte * len(s[j].encode("utf-8", "surrogatepass"))) > best[i]:
                best[i], back[i], pick[i] = x, j, -1
        while k is not None:
            if k >= 0 and (x := a + scores[k]) > best[i]:
                best[i], back[i], pick[i] = x, j, k
            i += 1
            if i > n:
                break
            k = get(s[j:i])
    out: list[int] = []
    while n:
        if pick[n] >= 0:
            out.append(pick[n])
        else:
            out += _spelled(v, s[back[n] : n])
        n = back[n]
    return tuple(reversed(out))


def _spelled(v: Vocabulary, c: str) -> list[int]:
    """The ids of a character outside the vocabulary, the last one first."""
    return [v.byte_ids[b] for b in reversed(c.encode("utf-8", "surrogatepass"))] if v.byte_ids else [v.unknown_id]


class Encoder:
    """A Viterbi search over a stream of prepared text that gives ids as soon as they are settled.

    ``best``, ``back`` and ``pick`` hold the places from the last committed
    boundary on, of which only the last ``longest`` can still be extended. Every
    ``longest`` characters the surviving paths, those that lead into a place
    ahead, are followed back; where they meet, the ids before are committed and
    the places before are dropped; only where paths never meet, as in a run of one
    letter, their places wait. A character outside the vocabulary is spelled
    in bytes. A tie goes to the path that was found first, from the left.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.base, self.next, self.rest = v, 0, 0, ""  # rest: text from the first place that isn't searched yet
        self.best, self.back, self.pick, self.odd = [0], [0], [-1], [""]
        self.due = v.longest

    def feed(self, text: str) -> list[int]:
        """Ids that are settled by more text. The last characters wait, as pieces may go beyond them."""
        return self._search(self.rest + text, False)

    def finish(self) -> list[int]:
        """The ids that are left."""
        out = self._search(self.rest, True)
        self._commit(self.next, out)
        return out

    def _search(self, s: str, last: bool) -> list[int]:
        get, scores, byte = self.v.prefixes.get, self.v.scores, self.v.byte_score
        best, back, pick, odd, base = self.best, self.back, self.pick, self.odd, self.base
        n, out, start = len(s), [], self.next
        for j in range(n if last else max(0, n - self.v.longest)):
            o = start + j - base
            a, i, at = best[o], j + 1, o + 1
            k = get(s[j:i])
            if at == len(best):
                best.append(-math.inf)
                back.append(0)
                pick.append(-1)
                odd.append("")
            if k is None or k < 0:
                if (x := a + byte * len(s[j].encode("utf-8", "surrogatepass"))) > best[at]:
                    best[at], back[at], pick[at], odd[at] = x, start + j, -1, s[j]
            while k is not None:
                if k >= 0 and (x := a + scores[k]) > best[at]:
                    best[at], back[at], pick[at] = x, start + j, k
                i += 1
                at += 1
                if i > n:
                    break
                k = get(s[j:i])
                if at == len(best) and k is not None:
                    best.append(-math.inf)
                    back.append(0)
                    pick.append(-1)
                    odd.append("")
            self.next = start + j + 1
            if self.next >= self.due:
                self.due = self.next + self.v.longest
                alive = {back[t] for t in range(self.next - base, len(best)) if best[t] > -math.inf}
                while len(alive) > 1:
                    top = max(alive)
                    if top <= base:
                        break
                    alive.remove(top)
                    alive.add(back[top - base])
                if len(alive) == 1 and (at := alive.pop()) > base:
                    self._commit(at, out)
                    base = self.base
        self.rest = s[self.next - start :]
        return out

    def _commit(self, place: int, out: list[int]) -> None:
        """Put out the ids up to ``place``, and forget what is before it."""
        found: list[int] = []
        at, base = place, self.base
        while at > base:
            k = self.pick[at - base]
            if k >= 0:
                found.append(k)
            else:
                found += _spelled(self.v, self.odd[at - base])
            at = self.back[at - base]
        out += reversed(found)
        for x in (self.best, self.back, self.pick, self.odd):
            del x[: place - base]
        self.base = place


class Memory:
    """Results by segment in two generations: when the young one is full, it becomes the old one, and that is dropped."""

    def __init__(self, size: int = MEMO_SIZE):
        self.size, self.young, self.old = size, {}, {}

    def put(self, s: str, value) -> None:
        if len(s) <= MEMO_CHARS:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[s] = value


def encode(v: Vocabulary, text: str | None) -> list[int]:
    """Ids of a whole text; null and empty texts have none."""
    out: list[int] = []
    if not text:
        return out
    memo, extend = v.memo, out.extend
    for s in segments(v, text):
        found = memo.young.get(s)
        if found is None:
            found = memo.old.get(s) or best_path(v, s)
            memo.put(s, found)
        extend(found)
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and bytes joined, without the space that was put in front."""
    raw = b"".join(map(v.bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def log_marginal(table: dict[str, float], byte: float, s: str) -> float:
    """Natural log of the summed probability of all segmentations of ``s``, by a forward recursion in log space.

    ``table``: log probabilities of pieces, with their beginnings marked 1.0.
    A character outside the vocabulary is spelled in bytes.
    """
    get, exp, log1p, n = table.get, math.exp, math.log1p, len(s)
    total: list[float | None] = [None] * (n + 1)
    total[0] = 0.0
    for j in range(n):
        a, i = total[j], j + 1
        p = get(s[j])
        if p is None or p > 0:
            x, y = a + byte * len(s[j].encode("utf-8", "surrogatepass")), total[i]
            total[i] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        while p is not None:
            if p <= 0:
                x, y = a + p, total[i]
                total[i] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            i += 1
            if i > n:
                break
            p = get(s[j:i])
    return total[n]


#: Below this a sum of products may have lost terms, and the recursion is done in log space.
LEAST_SUM = 1e-250


def tree(table: dict[str, float], byte: float) -> dict:
    """The pieces of ``table`` by character: (probability, 0 where no piece ends; what may follow), for ``log_marginal_of``. First characters that are no pieces have that of their bytes."""
    root: dict = {}
    below = {"": root}
    for k in sorted(table, key=len):  # beginnings are keys as well
        p = table[k]
        below[k] = {}
        spelled = math.exp(byte * len(k.encode("utf-8", "surrogatepass"))) if len(k) == 1 else 0.0
        below[k[:-1]][k[-1]] = (math.exp(p) if p <= 0 else spelled, below[k])
    return root


def log_marginal_of(root: dict, table: dict[str, float], byte: float, s: str) -> float:
    """``log_marginal`` by a forward recursion over plain probabilities (``root``: ``tree(table, byte)``), which takes one logarithm; in log space where the sum is too small."""
    n = len(s)
    if n <= MEMO_CHARS:
        total = [0.0] * (n + 1)
        total[0] = 1.0
        for j in range(n):
            a, i, below = total[j], j, root
            for c in s[j:] if j else s:
                found = below.get(c)
                if found is None:
                    break
                i += 1
                p, below = found
                total[i] += a * p
            if i == j:  # in no piece: spelled in bytes
                total[j + 1] += a * math.exp(byte * len(s[j].encode("utf-8", "surrogatepass")))
        if total[n] > LEAST_SUM:
            return math.log(total[n])
    return log_marginal(table, byte, s)
