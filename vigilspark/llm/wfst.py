"""Weighted finite-state transducers over the tropical semiring: costs add along a path, the least path counts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import NamedTuple

INFINITE = float("inf")


class Arc(NamedTuple):
    out: str
    cost: float
    to: int


class Fst:
    """States are numbered; state 0 starts; arcs consume one symbol each and write one."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, list[Arc]]] = []
        self.final: dict[int, float] = {}

    def state(self, final: float | None = 0.0) -> int:
        self.arcs.append({})
        if final is not None:
            self.final[len(self.arcs) - 1] = final
        return len(self.arcs) - 1

    def arc(self, of: int, symbol: str, out: str, cost: float, to: int) -> None:
        self.arcs[of].setdefault(symbol, []).append(Arc(out, cost, to))

    def loop(self, of: int, symbols: Iterable[str]) -> None:
        for s in symbols:
            self.arc(of, s, s, 0.0, of)


def compose(first: Fst, second: Fst) -> Fst:
    """The transducer that passes what first writes to second; only states that a path reaches are made."""
    out, number, todo = Fst(), {(0, 0): 0}, [(0, 0)]
    out.state(first.final.get(0, INFINITE) + second.final.get(0, INFINITE))
    while todo:
        a, b = pair = todo.pop()
        for symbol, arcs in first.arcs[a].items():
            for x in arcs:
                for y in second.arcs[b].get(x.out, ()):
                    to = (x.to, y.to)
                    if to not in number:
                        number[to] = out.state(first.final.get(x.to, INFINITE) + second.final.get(y.to, INFINITE))
                        todo.append(to)
                    out.arc(number[pair], symbol, y.out, x.cost + y.cost, number[to])
    return out


def least_cost(machine: Fst, symbols: Sequence[str]) -> float:
    """Cost of the shortest path of symbols through the machine; INFINITE if it has none."""
    now = {0: 0.0}
    for s in symbols:
        after: dict[int, float] = {}
        for state, cost in now.items():
            for a in machine.arcs[state].get(s, ()):
                if cost + a.cost < after.get(a.to, INFINITE):
                    after[a.to] = cost + a.cost
        now = after
    return min((cost + machine.final.get(state, INFINITE) for state, cost in now.items()), default=INFINITE)


class Sequential(NamedTuple):
    """A transducer with one arc for each state and symbol: step(state, symbol) -> (output, state), over strings."""

    start: int
    table: dict[tuple[int, str], tuple[str, int]]
    other: dict[int, tuple[str, int]]  # for symbols without an arc of their own: what goes before the symbol itself
    loops: dict[int, dict[int, str]] = {}  # noqa: RUF012  states that no arc leaves and that write symbol for symbol, as tables

    def run(self, state: int, symbols: str) -> tuple[str, int]:
        """What the only path of symbols from state writes, and the state it ends in."""
        if state in self.loops:
            return symbols.translate(self.loops[state]), state
        out = []
        for s in symbols:
            if (arc := self.table.get((state, s))) is None:
                before, state = self.other[state]
                out.append(before + s)
            else:
                out.append(arc[0])
                state = arc[1]
        return "".join(out), state


def shortest_path(symbols: Sequence, start: Hashable, arcs: Callable[[Sequence, int, Hashable], Iterator[tuple[int, Hashable, float, object]]]) -> list | None:
    """Outputs along the least path from (0, start) to the end of symbols in a machine composed with them, whose states
    (position, state) are made as the search meets them: arcs(symbols, position, state) -> (position, state, cost, output)
    further on, taken one at a time. Costs must not be negative. The farthest of equally near positions goes first; of
    equal paths to a state the one whose last arc is longest counts; None if no path ends."""
    end, least, back, made = len(symbols), {(0, start): 0.0}, {}, 0
    heap = [(0.0, 0, 0, start, arcs(symbols, 0, start))]
    while heap:
        cost, place, _, state, rest = heap[0]
        here = (-place, state)
        if -place == end:
            out = []
            while here in back:
                here, written = back[here]
                out.append(written)
            return out[::-1]
        arc = None if cost > least[here] else next(rest, None)
        if arc is None:
            heapq.heappop(heap)
            continue
        to, after, price, written = arc
        reached, total = (to, after), cost + price
        known = least.get(reached, INFINITE)
        if total < known:
            least[reached] = total
            back[reached] = (here, written)
            made += 1
            heapq.heappush(heap, (total, -to, made, after, arcs(symbols, to, after) if to < end else None))
        elif total == known and -place < back[reached][0][0]:
            back[reached] = (here, written)
    return None
