"""Access paths: which indexes would serve a query, as a tree that explains itself.

The tree tells what an ordered store with these indexes would do. Spark runs the one filter that the query lowers to and
prunes by Parquet statistics; on a sorted index projection those statistics are the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from keyloom.functions import semantics as S
from keyloom.plans.ir import And, Node, Not, Or, Predicate, Query


@dataclass(frozen=True)
class Index:
    name: str
    members: tuple[str, ...]
    unique: bool = False

    @property
    def composite(self) -> bool:
        return len(self.members) > 1


@dataclass(frozen=True)
class Step:
    label: str
    inputs: tuple[Step, ...] = ()
    rank: int = 0
    equal: Predicate | None = None

    def explain(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.label, *(i.explain(depth + 1) for i in self.inputs)])


#: How many rows a seek is taken to give, for the order of an intersection.
UNIQUE, SOME, MANY = 1, 1000, 1 << 31


class Planner:
    def __init__(self, indexes: list[Index]):
        self.indexes = list(indexes)

    def _single(self, member: str) -> Index | None:
        return next((i for i in self.indexes if i.members == (member,)), None)

    def _covering(self, members: tuple[str, ...]) -> Index | None:
        return next((i for i in self.indexes if i.members == members), None)

    def _seek(self, p: Predicate) -> Step | None:
        index = self._single(p.member) if p.op != S.PREFIX else None
        if index is None:
            return None
        if p.op == S.EQUAL:
            return Step(f"IndexEqualSeek({p.member} == ?, idx={index.name})", rank=UNIQUE if index.unique else SOME, equal=p)
        return Step(f"IndexRangeSeek({p.member}, idx={index.name})", rank=MANY)

    def _indexable(self, node: Node) -> Step | None:
        """A source of keys if the whole node is served by indexes."""
        if isinstance(node, Predicate):
            return self._seek(node)
        if isinstance(node, Not) or not node.children:
            return None
        parts = [self._indexable(c) for c in node.children]
        if None in parts:
            return None
        if len(parts) == 1:
            return parts[0]
        if isinstance(node, And):
            return Step("Intersect (AND)", tuple(sorted(parts, key=lambda s: s.rank)), MANY)
        return Step("Union (OR)", tuple(parts), MANY)

    def _compile(self, node: Node | None) -> tuple[Step | None, bool]:
        """(source of keys, whether a residual predicate remains)."""
        if node is None:
            return None, False
        if isinstance(node, Predicate):
            seek = self._seek(node)
            return seek, seek is None
        if isinstance(node, And):
            found = [self._compile(c) for c in node.children]
            seeks, residual = [s for s, _ in found if s], any(r for _, r in found)
            if len(seeks) > 1:
                return Step("Intersect (AND)", tuple(sorted(seeks, key=lambda s: s.rank)), MANY), residual
            return (seeks[0] if seeks else None), residual
        if isinstance(node, Or):
            union = self._indexable(node)
            return union, union is None
        return None, True

    def plan(self, q: Query) -> Step:
        source, residual = self._compile(q.filter)
        keyed = q.has_from or q.has_to
        fields = tuple(s.member for s in q.sorts if s.member is not None)
        one_way = len({s.descending for s in q.sorts}) <= 1
        all_fields = bool(q.sorts) and len(fields) == len(q.sorts)
        down = bool(q.sorts) and q.sorts[0].descending
        back = ", backward" if down else ""
        sort = bool(q.sorts)
        equal = source.equal if source else None
        if equal and not residual and not keyed and all_fields and one_way and equal.member not in fields and (i := self._covering((equal.member, *fields))):
            rows, sort = Step("Fetch", (Step(f"IndexPrefixSeek({equal.member} == ?, idx={i.name}{back})"),)), False
        elif source:
            rows = Step("Fetch", (source,))
        elif all_fields and one_way and (i := self._covering(fields)):
            rows, sort = Step("Fetch", (Step(f"IndexOrderedScan(idx={i.name}{back})"),)), False
        else:
            only_key = len(q.sorts) == 1 and q.sorts[0].member is None
            backward = only_key and down and not residual
            rows = Step(("KeyRangeScan" if keyed else "TableScan") + (" (backward)" if backward else ""))
            if only_key and not residual:
                sort = False
        if residual or keyed:
            rows = Step("Filter", (rows,))
        if sort:
            return Step("Sort" + (f" (Top-{q.skip + q.take})" if q.take is not None else ""), (rows,))
        if q.skip > 0 or q.take is not None:
            return Step(f"Limit(skip={q.skip}, take={'all' if q.take is None else q.take})", (rows,))
        return rows
