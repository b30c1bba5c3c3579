"""The stage language: what a transform may say, as frozen dataclasses, and the parser that accepts nothing else."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class TransformError(ValueError):
    """Base of all errors of a transform definition."""


class UnsupportedStage(TransformError):
    """A stage name that the language does not have."""


class InvalidStage(TransformError):
    """A known stage with a body that it does not accept."""


class FreeFormScript(TransformError):
    """A script, which affect analysis could not see through."""


@dataclass(frozen=True)
class Project:
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Match:
    field: str
    value: Any


@dataclass(frozen=True)
class Copy:
    field: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class AddFields:
    entries: tuple[tuple[str, Copy | Literal], ...]


@dataclass(frozen=True)
class Unset:
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Rename:
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Lookup:
    table: str
    schema: str | None
    local: str
    foreign: str
    name: str


@dataclass(frozen=True)
class Unwind:
    path: str


@dataclass(frozen=True)
class Union:
    table: str
    schema: str | None


@dataclass(frozen=True)
class Aggregate:
    name: str
    op: str
    field: str


@dataclass(frozen=True)
class Group:
    """Keys alone: distinct. One add_to_set, and nothing beside it: a set. Otherwise sum, count, min, max, avg."""

    keys: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]

    @property
    def counted(self) -> bool:
        """Whether value-level skips need counts of its keys or members."""
        return not self.aggregates or self.aggregates[0].op == "add_to_set"


Stage = Project | Match | AddFields | Unset | Rename | Lookup | Unwind | Union | Group

#: Fixed values of the language.
SCRIPTS = ("script", "function", "$function", "$where", "$accumulator")
ACCUMULATORS = {"$sum": "sum", "$count": "count", "$min": "min", "$max": "max", "$avg": "avg", "$addToSet": "add_to_set"}


def _name(value: Any, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise InvalidStage(f"{what} must be a non-empty name")
    return value


def _mapping(value: Any, what: str) -> dict:
    if not isinstance(value, dict) or not value:
        raise InvalidStage(f"{what} must be a non-empty map")
    return value


def _only(body: dict, allowed: set[str], what: str) -> None:
    if extra := sorted(set(body) - allowed):
        raise InvalidStage(f"{what} does not support {', '.join(extra)}")


def _classic(body: dict, what: str) -> None:
    if set(body) == {"fields"}:
        raise InvalidStage(f"{what} does not accept a fields list; name the fields directly")


def _table(body: dict, key: str, what: str) -> tuple[str, str | None]:
    schema = body.get("fromSchema")
    if schema is not None and not isinstance(schema, str):
        raise InvalidStage(f"{what}.fromSchema must be a string")
    return _name(body.get(key), f"{what}.{key}").strip(), (schema or "").strip() or None


def _ref(value: Any, what: str) -> str:
    field = _name(value, what).strip().removeprefix("$").strip()
    if not field or "." in field:
        raise InvalidStage(f"{what} must be a single field, as FIELD or $FIELD")
    return field


def _project(body: Any) -> Project:
    body = _mapping(body, "$project")
    if isinstance(body.get("fields"), list):
        _only(body, {"fields"}, "$project")
        names = tuple(_name(f, "$project field") for f in body["fields"])
        if not names:
            raise InvalidStage("$project must name a field")
        return Project(names)
    for field, flag in body.items():
        _name(field, "$project field")
        if field.startswith("$") or not (flag is True or (type(flag) is int and flag == 1)):
            raise InvalidStage(f"$project {field}: only inclusion, as 1 or true")
    return Project(tuple(body))


def _match(body: Any) -> Match:
    body = _mapping(body, "$match")
    if len(body) != 1:
        raise InvalidStage("$match takes exactly one equality")
    field, value = next(iter(body.items()))
    if _name(field, "$match field").startswith("$"):
        raise InvalidStage(f"$match does not support {field}")
    if isinstance(value, dict):
        if set(value) != {"$eq"}:
            raise InvalidStage("$match supports equality only")
        value = value["$eq"]
    return Match(field, value)


def _add_fields(body: Any) -> AddFields:
    body = _mapping(body, "$addFields")
    _classic(body, "$addFields")
    entries: list[tuple[str, Copy | Literal]] = []
    for name, value in body.items():
        if _name(name, "$addFields field").startswith("$"):
            raise InvalidStage(f"$addFields does not support {name}")
        if isinstance(value, str) and value.startswith("$"):
            entries.append((name, Copy(_name(value[1:].strip(), f"$addFields {name}"))))
        elif isinstance(value, dict) and set(value) == {"$literal"}:
            entries.append((name, Literal(value["$literal"])))
        elif isinstance(value, dict) and any(str(k).startswith("$") for k in value):
            raise InvalidStage(f"$addFields {name}: a field or a literal, no expression")
        else:
            entries.append((name, Literal(value)))
    return AddFields(tuple(entries))


def _unset(body: Any) -> Unset:
    names = [body] if isinstance(body, str) else body
    if not isinstance(names, list) or not names:
        raise InvalidStage("$unset must be a field or a list of fields")
    return Unset(tuple(_name(f, "$unset field") for f in names))


def _rename(body: Any) -> Rename:
    body = _mapping(body, "$rename")
    _classic(body, "$rename")
    return Rename(tuple((_name(a, "$rename from"), _name(b, f"$rename {a}")) for a, b in body.items()))


def _lookup(body: Any) -> Lookup:
    body = _mapping(body, "$lookup")
    _only(body, {"from", "localField", "foreignField", "as", "fromSchema"}, "$lookup")
    table, schema = _table(body, "from", "$lookup")
    return Lookup(table, schema, *(_name(body.get(k), f"$lookup.{k}").strip() for k in ("localField", "foreignField", "as")))


def _unwind(body: Any) -> Unwind:
    if isinstance(body, dict):
        _only(body, {"path"}, "$unwind")
        body = body.get("path")
    return Unwind(_name(_name(body, "$unwind path").strip().removeprefix("$"), "$unwind path"))


def _union(body: Any) -> Union:
    if isinstance(body, str):
        return Union(_name(body, "$unionWith").strip(), None)
    body = _mapping(body, "$unionWith")
    _only(body, {"coll", "from", "fromSchema"}, "$unionWith")
    if "coll" in body and "from" in body:
        raise InvalidStage("$unionWith takes one of coll and from")
    return Union(*_table(body, "coll" if "coll" in body else "from", "$unionWith"))


def _group(body: Any) -> Group:
    body = _mapping(body, "$group")
    if body.get("_id") is None:
        raise InvalidStage("$group needs an _id of at least one field")
    key = body["_id"]
    if isinstance(key, dict):
        keys = tuple(_ref(v, "$group._id") for v in _mapping(key, "$group._id").values())
        if keys != tuple(key):
            raise InvalidStage("$group._id: an alias must be the field's own name")
    elif isinstance(key, list) and key:
        keys = tuple(_ref(v, "$group._id") for v in key)
    else:
        keys = (_ref(key, "$group._id"),)
    aggregates = []
    for name, spec in body.items():
        if name == "_id":
            continue
        _name(name, "$group output")
        if not isinstance(spec, dict) or len(spec) != 1:
            raise InvalidStage(f"$group {name} must have one accumulator")
        op, field = next(iter(spec.items()))
        if op not in ACCUMULATORS:
            raise InvalidStage(f"$group {name}: {op} is no accumulator of this language")
        aggregates.append(Aggregate(name, ACCUMULATORS[op], _ref(field, f"$group {name}")))
    if len(aggregates) > 1 and any(a.op == "add_to_set" for a in aggregates):
        raise InvalidStage("$group takes $addToSet alone")
    return Group(keys, tuple(aggregates))


_PARSERS = {"$project": _project, "$match": _match, "$addFields": _add_fields, "$set": _add_fields, "$unset": _unset, "$rename": _rename, "$lookup": _lookup, "$unwind": _unwind, "$unionWith": _union, "$group": _group}


def parse(steps: Any) -> tuple[Stage, ...]:
    """The stages of a transform, or the error that says which step is wrong."""
    if not isinstance(steps, list) or not steps:
        raise InvalidStage("a transform is a non-empty list of stages")
    out: list[Stage] = []
    for i, step in enumerate(steps, 1):
        if not isinstance(step, dict) or len(step) != 1:
            if isinstance(step, dict) and set(step) & set(SCRIPTS):
                raise FreeFormScript(f"step {i}: scripts are refused")
            raise InvalidStage(f"step {i}: a stage is a map with one key")
        name, body = next(iter(step.items()))
        if name in SCRIPTS:
            raise FreeFormScript(f"step {i}: scripts are refused")
        if name not in _PARSERS:
            raise UnsupportedStage(f"step {i}: {name} is no stage of this language")
        try:
            out.append(_PARSERS[name](body))
        except InvalidStage as e:
            raise InvalidStage(f"step {i}: {e}") from None
    counted = [s for s in out if isinstance(s, Group) and s.counted]
    if len(counted) > 1:
        raise InvalidStage("at most one distinct or $addToSet in a transform")
    if counted and any(isinstance(s, Unwind | Union) for s in out):
        raise InvalidStage("distinct and $addToSet do not combine with $unwind or $unionWith")
    return tuple(out)


def references(stages: tuple[Stage, ...], schema: str | None = None) -> list[tuple[str | None, str]]:
    """The other tables that the stages read, as (schema, table), once each."""
    return list(dict.fromkeys((s.schema or schema, s.table) for s in stages if isinstance(s, Lookup | Union)))
