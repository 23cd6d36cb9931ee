"""Probabilistic automata of credential formats, learned by merging prefix-tree states (grammar inference)."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

END = "$"


def symbol(c: str) -> str:
    """Characters by class, so that samples of one format share paths: digits, hex letters, other letters, or themselves."""
    if c.isdigit():
        return "0"
    if c in "abcdef":
        return "a"
    if c in "ABCDEF":
        return "A"
    if c.isalpha():
        return "z" if c.islower() else "Z"
    return c


@dataclass
class State:
    seen: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)


@dataclass
class Automaton:
    """States with counts; probabilities are smoothed over the alphabet."""

    states: list[State]
    alphabet: int = 70

    def log_likelihood(self, token: str) -> float:
        """The mean log probability a character, the end included."""
        at, total = 0, 0.0
        for c in [*map(symbol, token), END]:
            state = self.states[at] if at is not None else None
            if state is None:
                total += -math.log(self.alphabet)
                continue
            n = state.ends if c == END else state.counts[c]
            total += math.log((n + 0.1) / (state.seen + 0.1 * self.alphabet))
            at = state.to.get(c) if c != END else at
        return total / (len(token) + 1)


def prefix_tree(samples: list[str]) -> list[State]:
    tree = [State()]
    for s in samples:
        at = 0
        tree[0].seen += 1
        for c in map(symbol, s):
            tree[at].counts[c] += 1
            if c not in tree[at].to:
                tree[at].to[c] = len(tree)
                tree.append(State())
            at = tree[at].to[c]
            tree[at].seen += 1
        tree[at].ends += 1
    return tree


def differ(n1: int, of1: int, n2: int, of2: int, alpha: float) -> bool:
    """Hoeffding bound: the two frequencies differ more than chance allows."""
    if not of1 or not of2:
        return False
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(of1) + 1 / math.sqrt(of2))
    return abs(n1 / of1 - n2 / of2) > bound


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """Merges statistically compatible states of the samples' prefix tree.

    Red states are final; each blue state (a child of a red one) is folded into the first red state whose end and letter
    frequencies, and whose successors', agree with its own, or else becomes red.
    """
    tree = prefix_tree(samples)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = tree[a], tree[b]
            if differ(x.ends, x.seen, y.ends, y.seen, alpha) or any(differ(x.counts[c], x.seen, y.counts[c], y.seen, alpha) for c in {*x.counts, *y.counts}):
                return False
            todo += [(x.to[c], y.to[c]) for c in x.to.keys() & y.to.keys() if x.to[c] != a or y.to[c] != b]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = tree[a], tree[b]
            x.seen, x.ends, x.counts = x.seen + y.seen, x.ends + y.ends, x.counts + y.counts
            for c, child in y.to.items():
                if c in x.to:
                    todo.append((x.to[c], child))
                else:
                    x.to[c] = child

    red, settled = [0], {0}
    while blue := sorted({(child, r, c) for r in red for c, child in tree[r].to.items() if child not in settled}):
        child, parent, c = blue[0]
        same = next((r for r in red if compatible(r, child)), None)
        if same is None:
            red.append(child)
            settled.add(child)
            continue
        tree[parent].to[c] = same
        fold(same, child)
    names = {r: k for k, r in enumerate(red)}
    return Automaton([State(tree[r].seen, tree[r].ends, {c: names[t] for c, t in tree[r].to.items()}, tree[r].counts) for r in red])
