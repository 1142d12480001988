"""A dictionary automaton over many terms, run over whole batches of texts.

The terms form a trie; each state's failure link is the longest proper suffix
that is a state, too.  Filled up along these links, the trie becomes one dense
table (state, character class) -> state, so every character costs one lookup
whatever the number of terms.  A state tells the terms that end there: its own,
and those of the next terminal state along the links.

Texts are cut into lanes of ``LANE`` characters, each begun as many characters
early as the longest term has less one, so a lane's states are right from its
own first character on.  All lanes of a batch step together, which makes the
table lookups vector operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

LANE = 256


class Automaton:
    """The table of some distinct, non-empty terms."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.longest = max(map(len, terms))
        letters = sorted({ord(c) for t in terms for c in t})
        #: character to class; 0 for characters of no term
        self.classes = np.zeros(letters[-1] + 2, np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for number, term in enumerate(terms):
            state = 0
            for c in self.classes[[ord(x) for x in term]].tolist():
                after = children[state].get(c)
                if after is None:
                    after = children[state][c] = len(children)
                    children.append({})
                    own.append(-1)
                state = after
            own[state] = number
        n = len(children)
        self.table = np.zeros((n, self.width), np.int32)
        self.own = np.array(own, np.int64)
        #: the next state along the links at which a term ends (0: none)
        self.next = np.zeros(n, np.int64)
        fail = np.zeros(n, np.int64)
        queue = [0]
        for state in queue:  # in order of depth: a link always leads to a finished state
            back = int(fail[state])
            if state:
                self.table[state] = self.table[back]
                self.next[state] = back if own[back] >= 0 else self.next[back]
            for c, after in children[state].items():
                fail[after] = self.table[back, c] if state else 0
                self.table[state, c] = after
                queue.append(after)
        self.ends = (self.own >= 0) | (self.next > 0)
        self.table = self.table.ravel()

    @property
    def size(self) -> int:
        """Bytes of the table."""
        return self.table.nbytes

    def hits(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the numbers of the terms it contains, ascending."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self.classes[np.minimum(points, len(self.classes) - 1)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        first = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        last = np.minimum(first + LANE, (begin + sizes)[text])
        early = np.maximum(first - self.longest + 1, begin[text])
        order = np.argsort(early - last, kind="stable")  # longest first
        text, first, last, early = text[order], first[order], last[order], early[order]
        state = np.zeros(len(text), np.int64)
        steps = int((last - early).max()) if len(text) else 0
        live = np.searchsorted(early - last, -np.arange(steps), side="left")
        n = len(self.own)
        seen = [np.zeros(0, np.int64)]
        for k, m in enumerate(live.tolist()):
            at = early[:m] + k
            now = state[:m] = self.table[state[:m] * self.width + classes[at]]
            hit = np.flatnonzero(self.ends[now] & (at >= first[:m]))
            if len(hit):
                seen.append(text[hit] * n + now[hit])
        pairs = np.unique(np.concatenate(seen))
        text, state = pairs // n, pairs % n
        found = [np.zeros(0, np.int64)]
        while len(state):
            ends = self.own[state] >= 0
            found.append(text[ends] * len(self.terms) + self.own[state[ends]])
            state = self.next[state]
            text, state = text[state > 0], state[state > 0]
        both = np.unique(np.concatenate(found))
        cut = np.searchsorted(both // len(self.terms), np.arange(len(texts) + 1))
        terms = both % len(self.terms)
        return [terms[a:b] for a, b in zip(cut[:-1], cut[1:])]


def table_bytes(terms: Iterable[str]) -> int:
    """An upper bound of the table's bytes, from the terms alone."""
    terms = list(terms)
    return 4 * (1 + sum(map(len, terms))) * (1 + len({c for t in terms for c in t}))


def parts(terms: list[str], limit: int) -> Iterator[list[str]]:
    """The terms in runs whose tables stay within ``limit`` bytes each (a
    longer term stands alone)."""
    held: list[str] = []
    states, letters = 1, set()
    for term in terms:
        more = letters | set(term)
        if held and 4 * (states + len(term)) * (1 + len(more)) > limit:
            yield held
            held, states, more = [], 1, set(term)
        held.append(term)
        states, letters = states + len(term), more
    if held:
        yield held
