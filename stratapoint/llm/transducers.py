"""Letter-to-letter finite-state transducers as tables, and their composition.

A machine reads one symbol and writes one at each step. The grammar of clauses is a
chain of three: negation, reported speech and targets, each of which rewrites the
symbols that stand in its scope. Composed, they are one table.
"""

from __future__ import annotations

from dataclasses import dataclass

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = "other", "insult", "threat", "target", "negation", "report", "end"
READ = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END)  # what the lexicon writes


@dataclass(frozen=True)
class Machine:
    """Arcs (state, symbol read) -> (state, symbol written). A symbol without an arc passes unchanged by the state's arc for ``other``."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        got = self.arcs.get((state, symbol))
        return got if got is not None else (self.arcs[state, OTHER][0], symbol)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, w = self.step(state, s)
            out.append(w)
        return out


def compose(a: Machine, b: Machine, read: tuple[str, ...] = READ) -> Machine:
    """The machine that writes what b writes on what a writes; its states are the pairs that can be reached."""
    number, todo, arcs = {(a.start, b.start): 0}, [(a.start, b.start)], {}
    while todo:
        pair = todo.pop()
        for s in read:
            na, middle = a.step(pair[0], s)
            nb, out = b.step(pair[1], middle)
            if (na, nb) not in number:
                number[na, nb] = len(number)
                todo.append((na, nb))
            arcs[number[pair], s] = (number[na, nb], out)
    return Machine(0, arcs)


def negation(reach: int) -> Machine:
    """An insult at most ``reach`` words after a negation, in the same clause, is a negated one."""
    arcs = {}
    for k in range(reach + 1):  # words that the negation still covers
        arcs[k, OTHER] = (max(k - 1, 0), OTHER)
        arcs[k, NEGATION] = (reach, NEGATION)
        arcs[k, END] = (0, END)
        if k:
            arcs[k, INSULT] = (k - 1, f"{INSULT} negated")
    return Machine(0, arcs)


def report() -> Machine:
    """An insult after a word of reporting or an opening quote, in the same clause, is a reported one, unless it is negated."""
    return Machine(0, {(0, OTHER): (0, OTHER), (0, REPORT): (1, REPORT), (1, OTHER): (1, OTHER), (1, END): (0, END), (1, INSULT): (1, f"{INSULT} reported")})


def target(reach: int) -> Machine:
    """Insults and threats at most ``reach`` words from a target, before or after it, hit it: the later of the two words is marked."""
    arcs, insults = {}, (INSULT, f"{INSULT} negated", f"{INSULT} reported")
    none = reach + 1
    states = {}  # words since a target, since an insult or threat (none: too many), and whether that was a threat
    for t in range(none + 1):
        for h in range(none + 1):
            for threat in (False, True):
                states[t, h, threat] = len(states)
    more = lambda n: min(n + 1, none)
    for (t, h, threat), at in states.items():
        arcs[at, OTHER] = (states[more(t), more(h), threat], OTHER)
        arcs[at, END] = (states[none, none, False], END)
        hit = h < reach
        arcs[at, TARGET] = (states[0, more(h), threat], f"{TARGET} hit by {THREAT if threat else INSULT}" if hit else TARGET)
        for s in insults:
            arcs[at, s] = (states[more(t), 0, False], f"{s} at target" if t < reach else s)
        arcs[at, THREAT] = (states[more(t), 0, True], f"{THREAT} at target" if t < reach else THREAT)
    return Machine(states[none, none, False], arcs)


def clause_grammar(reach: int) -> Machine:
    return compose(compose(negation(reach), report()), target(reach))
