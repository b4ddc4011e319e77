"""Values, paths and schemas of JSON documents, for kernels. A path is text like ``a[0].b`` or its tokens: keys and indices."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

from . import agreement, kernels, prose, readings

Token = str | int
MISSING = object()


def tokens(path: str) -> list[Token]:
    if not path:
        raise ValueError("a path is not empty")
    return [k or int(i) for k, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)]


def formatted(parts: Iterable[Token]) -> str:
    return "".join(f"[{t}]" if isinstance(t, int) else f".{t}" for t in parts).removeprefix(".")


def get(value, parts: Iterable[Token], default=MISSING):
    for t in parts:
        if isinstance(t, int) and isinstance(value, list) and t < len(value) or isinstance(t, str) and isinstance(value, dict) and t in value:
            value = value[t]
        else:
            return default
    return value


def put(target, parts: list[Token], value) -> None:
    """Sets a value, making objects and arrays on the way; gaps in arrays are null."""
    for at, t in enumerate(parts):
        if not isinstance(target, dict if isinstance(t, str) else list):
            raise TypeError(f"{formatted(parts[:at]) or 'the root'} cannot hold {t!r}")
        if isinstance(t, int):
            target.extend([None] * (t + 1 - len(target)))
        if at == len(parts) - 1:
            target[t] = value
            return
        if (target.get(t) if isinstance(t, str) else target[t]) is None:
            target[t] = [] if isinstance(parts[at + 1], int) else {}
        target = target[t]


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of what is neither object nor array; empty ones have none."""
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(k, str) and k:
                yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    elif path:
        yield path, value


def arrays(value, path: str = "") -> Iterator[tuple[str, list]]:
    """(path, array) of all arrays below the root, outer ones first."""
    if isinstance(value, list):
        if path:
            yield path, value
        for i, v in enumerate(value):
            yield from arrays(v, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, v in value.items():
            if isinstance(k, str) and k:
                yield from arrays(v, f"{path}.{k}" if path else k)


def pattern(path: str) -> tuple[str | None, ...] | None:
    """A path with its indices left open."""
    return tuple(None if isinstance(t, int) else t for t in tokens(path)) if path else None


def matching(value, shape: Iterable[str | None], path: tuple[Token, ...] = ()) -> Iterator[tuple[str, object]]:
    """(path, leaf) of what lies at a pattern; null items of arrays are passed over, objects and arrays are no leaves."""
    shape = tuple(shape)
    if not shape:
        if not isinstance(value, (dict, list)):
            yield formatted(path), value
    elif shape[0] is None:
        for i, v in enumerate(value if isinstance(value, list) else ()):
            if v is not None:
                yield from matching(v, shape[1:], (*path, i))
    elif isinstance(value, dict) and shape[0] in value:
        yield from matching(value[shape[0]], shape[1:], (*path, shape[0]))


def dotted(value, path: str):
    """The value at keys and indices between dots; the empty path is the root; None if it is not there."""
    for part in path.split(".") if path else ():
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


# --- rules and documents -------------------------------------------------------------------------------------------------------------------------------


def inflated(rules: Iterable[dict]) -> dict:
    """The document that field rules state; of several rules for a path the first that has a value counts."""
    out: dict = {}
    for r in rules:
        if path := r.get("field_path"):
            if get(out, tokens(path), None) is None:
                put(out, tokens(path), r.get("expected_value"))
    return out


def drift(a, b, path: str = "") -> list[str]:
    """Where two documents differ: what one lacks, other types, other values."""
    name = path or "<root>"
    if type(a) is not type(b) and a is not None and b is not None:
        return [f"{name}: type mismatch ({type(a).__name__} vs {type(b).__name__})"]
    if isinstance(a, (dict, list)) and isinstance(b, (dict, list)):
        keys = sorted(set(a) | set(b)) if isinstance(a, dict) else range(max(len(a), len(b)))
        out = []
        for k in keys:
            at = f"{path}[{k}]" if isinstance(a, list) else f"{path}.{k}" if path else k
            has = [k in x if isinstance(x, dict) else k < len(x) for x in (a, b)]
            out += drift(a[k], b[k], at) if all(has) else [f"{at}: missing in {'rules-derived' if not has[0] else 'expected_output'}"]
        return out
    return [] if a == b else [f"{name}: value mismatch ({a!r} vs {b!r})"]


def rule_id(rule: dict, length: int = 16) -> str:
    """A hash of a rule without its id, keys in order, behind its page."""
    body = json.dumps({k: v for k, v in rule.items() if k != "id"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    page = rule.get("page")
    return hashlib.sha256(f"{'' if page is None else page}\0{body}".encode()).hexdigest()[:length]


def projected(value, paths: list[tuple[str, ...]], identity: dict[tuple, list[str]], at: tuple = ()):
    """What lies at some dotted paths, through arrays; rows keep their identity keys. MISSING if nothing does."""
    if any(not p for p in paths):
        return copy.deepcopy(value)
    if isinstance(value, list):
        rows = []
        for row in value:
            got = projected(row, paths, identity, at)
            if got is not MISSING:
                if isinstance(row, dict) and isinstance(got, dict):
                    got |= {k: copy.deepcopy(row[k]) for k in identity.get(at, ()) if k in row and k not in got}
                rows.append(got)
        return rows or MISSING
    if not isinstance(value, dict):
        return MISSING
    tails = defaultdict(list)
    for p in paths:
        tails[p[0]].append(p[1:])
    out = {k: got for k, rest in tails.items() if k in value and (got := projected(value[k], rest, identity, (*at, k))) is not MISSING}
    return out or MISSING


def identity_keys(rules: Iterable[dict]) -> dict[tuple, list[str]]:
    """Keys by which the rows of an array are told apart, as rules with ``match_by:`` state them, by the array's path."""
    out = {}
    for r in rules:
        kind, _, keys = (r.get("structural") or "").partition(":")
        path = tokens(r["field_path"]) if r.get("field_path") else []
        names = [k.strip() for k in keys.split(",") if k.strip()]
        if kind == "match_by" and names and not any(isinstance(t, int) for t in path):
            out[tuple(path)] = names
    return out


def listed(value, rules: list[dict], schema: dict | None = None) -> tuple[object, str, list[str]]:
    """A prediction whose root is a list as an object: (object, mode, paths of rules that cannot be scored on it).

    Rows for the one array that rules name (``bare_rows``), one object (``singleton_doc``), or objects that wrap lists, merged (``wrapper_merge``). Keys are spelt
    as the schema spells them, where only their case differs; a rule whose own spelling differs is not scored.
    """
    if not isinstance(value, list):
        return value, "no_op", []
    folded = Counter(k.casefold() for k in (schema or {}).get("properties") or {})
    spelt = {k.casefold(): k for k in (schema or {}).get("properties") or {} if folded[k.casefold()] == 1}
    name = lambda k: spelt.get(k.casefold(), k)
    paths = [(r["field_path"], tokens(r["field_path"])) for r in rules if r.get("field_path")]
    other = [p for p, t in paths if isinstance(t[0], str) and name(t[0]) != t[0]]
    fit = [(p, t) for p, t in paths if p not in other]
    tops = {name(t[0]) for _, t in fit if len(t) > 1 and isinstance(t[1], int)}
    scalar = [p for p, t in fit if not any(isinstance(x, int) for x in t)]
    whole = all(isinstance(x, dict) for x in value)
    wraps = whole and any(isinstance(v, list) for x in value for v in x.values())
    if (rules or spelt) and not tops and len(value) == 1 and whole and not wraps:
        return {name(k): v for k, v in value[0].items()}, "singleton_doc", other
    if value and wraps:
        out: dict = {}
        for k, v in ((name(k), v) for x in value for k, v in x.items()):
            if isinstance(v, list):
                if isinstance(out.setdefault(k, []), list):
                    out[k] += [row for row in v if row is not None]
            elif v not in (None, ""):
                out.setdefault(k, v)
        return out, "wrapper_merge", other
    if len(tops) == 1:
        return {next(iter(tops)): value}, "bare_rows", scalar + other
    return value, "no_op", other


def lifted(value, schema: dict | None):
    """Rows that the schema declares as a repeated structure, moved from within other rows to the top."""
    repeated = (schema or {}).get("repeated_structure") if isinstance(schema, dict) else None
    if not isinstance(value, dict) or not isinstance(repeated, dict):
        return value
    out = dict(value)
    for k in repeated:
        holders = [p for p, v in value.items() if isinstance(v, list) and any(isinstance(r, dict) and isinstance(r.get(k), list) for r in v)]
        rows = [x for p in holders for r in value[p] if isinstance(r, dict) and isinstance(r.get(k), list) for x in r[k]]
        if k not in value and rows:
            out |= {p: [{a: b for a, b in r.items() if a != k} if isinstance(r, dict) else r for r in out[p]] for p in holders}
            out[k] = rows
    return out


def claims_alike(got, true, outer: str = "payment_details", inner: str = "claims"):
    """(got, true) with inner rows at the top on both sides where one side nests them, and a single outer object as a list where the other side has one."""
    if isinstance(got, dict) and isinstance(true, dict):
        a, b = got.get(outer), true.get(outer)
        if isinstance(a, dict) and isinstance(b, list):
            got = got | {outer: [a]}
        elif isinstance(b, dict) and isinstance(a, list):
            true = true | {outer: [b]}

    def nested(v) -> bool:
        return isinstance(v, dict) and isinstance(v.get(outer), list) and any(isinstance(p, dict) and isinstance(p.get(inner), list) for p in v[outer])

    top = lambda v: isinstance(v, dict) and isinstance(v.get(inner), list) and bool(v[inner])

    def flat(v: dict) -> dict:
        rows = [x for p in v[outer] if isinstance(p, dict) and isinstance(p.get(inner), list) for x in p[inner]]
        cut = [{k: x for k, x in p.items() if k != inner} if isinstance(p, dict) and isinstance(p.get(inner), list) else p for p in v[outer]]
        return v | {outer: cut, inner: list(v.get(inner) or []) + rows}

    if top(got) and nested(true) and not top(true):
        true = flat(true)
    elif top(true) and nested(got) and not top(got):
        got = flat(got)
    return got, true


# --- schemas --------------------------------------------------------------------------------------------------------------------------------------------------


def concrete(root, node):
    """A schema node with local references followed, and of alternatives the first that is an object or array, or else the first that is not null."""
    seen = set()
    while isinstance(node, dict):
        ref = node.get("$ref")
        if isinstance(ref, str) and ref.startswith("#/") and ref not in seen:
            seen.add(ref)
            node = get(root, [p.replace("~1", "/").replace("~0", "~") for p in ref[2:].split("/")], None)
            continue
        options = node.get("anyOf") or node.get("oneOf")
        if not isinstance(options, list):
            return node
        options = [o for o in (concrete(root, o) for o in options) if isinstance(o, dict) and o.get("type") != "null"]
        if not options:
            return node
        node = next((o for o in options if o.get("type") in ("object", "array") or "properties" in o or "items" in o), options[0])
    return node


def schema_at(schema, parts: Iterable[Token]):
    """The node of a schema at a path; None where it has none."""
    node = schema
    for t in parts:
        node = concrete(schema, node)
        if not isinstance(node, dict):
            return None
        if isinstance(t, int):
            node = node.get("items")
            continue
        if node.get("type") == "array" or "items" in node and "properties" not in node:
            node = concrete(schema, node.get("items")) or {}
        node = (node.get("properties") or {}).get(t)
        if node is None:
            return None
    return concrete(schema, node)


def schema_type(schema, path: str, value) -> str:
    """The type that a schema gives a path (integers are numbers), or else that of the value."""
    node = schema_at(schema, tokens(path)) if schema and path else None
    kind = node.get("type") if isinstance(node, dict) else None
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "null")
    kind = "number" if kind == "integer" else kind
    return kind if kind in ("string", "number", "boolean", "null") else readings.value_type(value)


def nullable_number(node) -> bool:
    if not isinstance(node, dict):
        return False
    kinds = {o.get("type") for o in node["anyOf"] if isinstance(o, dict)} if isinstance(node.get("anyOf"), list) and len(node["anyOf"]) == 2 else set()
    return {"number", "null"} in (kinds, set(node["type"]) if isinstance(node.get("type"), list) else None)


def nil(v):
    """0 is null where a schema says number or null."""
    return None if isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0 else v


# --- subset scores ----------------------------------------------------------------------------------------------------------------------------------------------

IDENTITIES = ("claim_number", "claim_id", "check_number", "invoice_number", "payment_id", "record_id")
#: Fields with two spellings: (the object that has them, the old one, the new one).
ALIASES = (("rendering_provider", "rendering_provider_identification_number", "provider_npi"),)
MOST_PAIRS = 250_000


def aliased(v):
    """Keys with a newer spelling, in that spelling."""
    if isinstance(v, list):
        return [aliased(x) for x in v]
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        for owner, old, new in ALIASES:
            if k == owner and isinstance(x, dict):
                x = {new if a == old else a: b for a, b in x.items()}
        out[k] = aliased(x)
    return out


def weight(v) -> int:
    """Leaves of a value; an empty object or array is one."""
    if isinstance(v, (dict, list)) and v:
        return sum(map(weight, v.values() if isinstance(v, dict) else v))
    return 1


def flat(v, cased: bool = False, path: tuple = ()) -> dict[tuple, object]:
    """Leaves with lower-cased texts and ISO dates, by path."""
    if isinstance(v, (dict, list)) and v:
        return {p: x for k, y in (v.items() if isinstance(v, dict) else enumerate(v)) for p, x in flat(y, cased, (*path, k)).items()}
    return {path: readings.whole_date(v if cased else v.lower()) if isinstance(v, str) else v}


def _identity(row) -> str | None:
    found = (str(row[k]).strip().lower() for k in IDENTITIES if isinstance(row, dict) and row.get(k) is not None)
    return next(filter(None, found), None)


def identity_cell(v) -> str:
    """A cell of an identity as a key: numbers by value, texts without case and punctuation."""
    if v is None:
        return ""
    if isinstance(v, str) and re.fullmatch(r"[-+]?\d[\d,]*\.?\d*", v.strip()):
        v = float(v.strip().replace(",", ""))
    return format(float(v), "g") if isinstance(v, (int, float)) and not isinstance(v, bool) else agreement.stable(v)


def row_pairs(true: list, got: list, keys: list[str] | None, cased: bool = False) -> list[int | None]:
    """The given row for each true row: by declared keys, by known identities, or by least differing leaves (in order where too many)."""
    if keys and all(isinstance(r, dict) for r in true):
        by, key = defaultdict(list), lambda r: tuple(identity_cell(r.get(k)) for k in keys)
        for j, r in enumerate(got):
            if isinstance(r, dict):
                by[key(r)].append(j)
        return [by[key(r)].pop(0) if by[key(r)] else None for r in true]
    own = [_identity(r) for r in true]
    if own and all(own):
        first: dict[str, int] = {}
        for j, r in enumerate(got):
            if k := _identity(r):
                first.setdefault(k, j)
        return [first.get(k) for k in own]
    if len(true) * len(got) > MOST_PAIRS:
        return [i if i < len(got) else None for i in range(len(true))]
    a, b = [flat(r, cased) for r in true], [flat(r, cased) for r in got]
    cost = np.array([[sum(p not in y or y[p] != v for p, v in x.items()) for y in b] for x in a], float)
    cost += np.abs(np.arange(len(a))[:, None] - np.arange(len(b))[None]) / (len(a) * len(b) + 1)
    of = dict(kernels.assign(cost))
    return [of.get(i) for i in range(len(true))]


def subset(true, got, keys: dict[tuple, list[str]] | None = None, schema=None, weighted: bool = True, cased: bool = False, path: tuple = (), root=None) -> tuple[float, int]:
    """(score, weight): how much of the true value the given one has. What goes beyond costs nothing. Texts score by edits, numbers by relative difference."""
    root = schema if root is None else root
    more = lambda v, w, node, at: subset(v, w, keys, node, weighted, cased, at, root)
    if isinstance(true, dict):
        if not isinstance(got, dict):
            return 0.0, weight(true)
        parts = [more(v, got.get(k), ((schema or {}).get("properties") or {}).get(k) if isinstance(schema, dict) else None, (*path, k)) for k, v in true.items()]
        total = sum(w for _, w in parts)
        shares = [w if weighted else 1 for _, w in parts]
        return (sum(s * w for (s, _), w in zip(parts, shares, strict=True)) / sum(shares), max(total, 1)) if parts else (1.0, 1)
    if isinstance(true, list):
        if not isinstance(got, list):
            return 0.0, weight(true)
        if not true:
            return 1.0, 1
        if not got:
            return 0.0, max(weight(true), 1)
        node = schema.get("items") if isinstance(schema, dict) else None
        parts = [more(x, got[j], node, path) if j is not None else (0.0, weight(x)) for x, j in zip(true, row_pairs(true, got, (keys or {}).get(path), cased), strict=True)]
        total = sum(w for _, w in parts)
        return (sum(s * w for s, w in parts) / total if weighted else sum(s for s, _ in parts) / max(len(true), len(got))), max(total, 1)
    if isinstance(true, str):
        if not isinstance(got, str):
            return 0.0, 1
        a, b = (readings.whole_date(s if cased else s.lower()) for s in (true, got))
        return (1 - prose.edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0), 1
    if nullable_number(schema) and nil(true) is None and (got is None or nil(got) is None):
        return 1.0, 1
    if true is None:
        return float(got is None), 1
    if not isinstance(got, (int, float)):
        return 0.0, 1
    return (1 - abs(true - got) / (abs(true) + abs(got)) if true or got else 1.0), 1


def subset_score(true, got, keys: dict[tuple, list[str]] | None = None, schema=None, weighted: bool = True, cased: bool = False) -> float:
    return subset(aliased(true), aliased(got), keys, schema, weighted, cased)[0]


# --- records --------------------------------------------------------------------------------------------------------------------------------------------------------


def record_counts(true: dict, got: dict, schema: dict, fuzzy: dict[str, float] | None = None) -> Counter | None:
    """Cells that agree, of the truth and of the prediction, and rows of both: arrays of objects by assignment of rows, other top-level fields one cell each.

    None where the schema has no array with named fields.
    """
    dated = lambda v: {k: dated(x) for k, x in v.items()} if isinstance(v, dict) else [dated(x) for x in v] if isinstance(v, list) else readings.whole_date(v)
    true, got, n = dated(true), dated(got), Counter()
    for field in sorted(set(true) | set(got)):
        node = schema_at(schema, [field])
        if isinstance(node, dict) and (node.get("type") == "array" or "items" in node):
            item = concrete(schema, node.get("items")) or {}
            names = list(item.get("properties") or {})
            if names:
                a, b = ([r if isinstance(r, dict) else {} for r in (v.get(field) or [])] if isinstance(v.get(field), list) else [] for v in (true, got))
                same = np.array([[sum(agreement.cell_equal(x.get(k), y.get(k), k, fuzzy) for k in names) for y in b] for x in a]).reshape(len(a), len(b))
                n["correct"] += int(sum(same[p] for p in kernels.assign(-same)))
                n.update(arrays=1, expected=len(a) * len(names), predicted=len(b) * len(names), expected_rows=len(a), predicted_rows=len(b))
        else:
            x, y = true.get(field), got.get(field)
            if nullable_number(node):
                x, y = nil(x), nil(y)
            n.update(expected=1, predicted=1, correct=int(agreement.cell_equal(x, y, field, fuzzy)))
    return n if n["arrays"] and n["expected"] else None
