"""JSON Schema compiled to columns over VARIANT.

A place of the document (the root, a property, an element of a list) has its rules, and
below it other places with theirs. Rules that combine sub-schemas (``anyOf``, ``oneOf``,
``not``, ``if``, ``contains``) use whether a sub-schema holds as one boolean; all others list what
is wrong. Kind, text, number and keys of a place that has a fixed name are columns of
their own, staged one level after the other, so each is computed once for all rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that need the evaluated places of other keywords, or another schema language.
UNSUPPORTED = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef", "dependencies", "additionalItems", "extends", "disallow")

# ``n`` is the turn of a message among those of one rule at one place.
VIOLATION = "struct<path:string,schema_path:string,n:int,message:string>"

Schema = dict | bool


class Stages:
    """Columns that are added to the table level by level; a level reads only levels before it."""

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.levels: list[list[Column]] = []

    def add(self, level: int, value: Column) -> Column:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self.prefix}{level}_{len(self.levels[level])}"
        self.levels[level].append(value.alias(name))
        return F.col(name)

    def names(self) -> list[str]:
        return [f"{self.prefix}{i}_{k}" for i, level in enumerate(self.levels) for k in range(len(level))]

    def apply(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.select("*", *level)
        return df


@dataclass
class Place:
    """A value, its display path and, if staged, the level at which its facts are added."""

    value: Column
    path: str | Column
    stages: Stages | None = None
    level: int = 0
    facts: dict[str, Column] = field(default_factory=dict)
    below: dict[object, Place] = field(default_factory=dict)

    def _fact(self, name: str, make: Callable[[], Column], level: int = 0) -> Column:
        if name not in self.facts:
            made = make()
            self.facts[name] = made if self.stages is None else self.stages.add(self.level + level, made)
        return self.facts[name]

    @property
    def kind(self) -> Column:
        """``OBJECT<...``, ``ARRAY<...`` or the type of a scalar, such as ``DECIMAL(2,1)``."""
        return self._fact("kind", lambda: F.schema_of_variant(self.value))

    @property
    def object(self) -> Column:
        return self._fact("object", lambda: F.try_variant_get(self.value, "$", "map<string,variant>"))

    @property
    def keys(self) -> Column:
        return self._fact("keys", lambda: F.map_keys(F.try_variant_get(self.value, "$", "map<string,variant>")))

    @property
    def array(self) -> Column:
        return self._fact("array", lambda: F.try_variant_get(self.value, "$", "array<variant>"))

    @property
    def text(self) -> Column:
        return self._fact("text", lambda: F.try_variant_get(self.value, "$", "string"))

    @property
    def number(self) -> Column:
        return self._fact("number", lambda: F.try_variant_get(self.value, "$", "double"))

    def is_a(self, name: str) -> Column:
        return {
            "object": F.startswith(self.kind, F.lit("OBJECT")),
            "array": F.startswith(self.kind, F.lit("ARRAY")),
            "string": self.kind == "STRING",
            "number": (self.kind == "BIGINT") | self.is_fraction(),
            "integer": (self.kind == "BIGINT") | (self.is_fraction() & (self.number == F.floor(self.number))),
            "boolean": self.kind == "BOOLEAN",
            "null": self.kind == "VOID",
        }[name]

    def is_fraction(self) -> Column:
        return F.startswith(self.kind, F.lit("DECIMAL")) | self.kind.isin("DOUBLE", "FLOAT")

    def equals_one(self, values: list) -> Column:
        """Whether the value is one of some constants; numbers are compared as doubles."""
        found = F.lit(False)
        texts = [v for v in values if isinstance(v, str)]
        numbers = [float(v) for v in values if isinstance(v, int | float) and not isinstance(v, bool)]
        nested = [v for v in values if isinstance(v, dict | list)]
        if texts:
            found = found | (self.is_a("string") & self.text.isin(*texts))
        if numbers:
            found = found | (self.is_a("number") & self.number.isin(*numbers))
        if flags := [str(v).lower() for v in values if isinstance(v, bool)]:
            found = found | (self.is_a("boolean") & self.text.isin(*flags))
        if None in values:
            found = found | self.is_a("null")
        if nested:
            found = found | F.to_json(self.value).isin(*[F.to_json(F.parse_json(F.lit(json.dumps(v)))) for v in nested])
        return found

    def shown(self) -> Column:
        """The value as it appears in a message."""
        text = F.try_variant_get(self.value, "$", "string")
        return (
            F.when(self.is_a("string"), F.concat(F.lit("'"), text, F.lit("'")))
            .when(self.kind == "VOID", "None")
            .when(self.kind == "BOOLEAN", F.initcap(text))
            .otherwise(F.to_json(self.value))
        )

    def _step(self, key: object, path: str, part: str) -> Place:
        if key not in self.below:
            value = F.try_variant_get(self.value, f"${part}", "variant")
            if self.stages is not None:
                value = self.stages.add(self.level, value)
            self.below[key] = Place(value, _joined(self.path, path), self.stages, self.level + 1)
        return self.below[key]

    def child(self, key: str) -> Place:
        """A property; its value is NULL only if the key is absent."""
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        return self._step(key, f".{key}", f"['{quoted}']")

    def item(self, index: int) -> Place:
        return self._step(index, f"[{index}]", f"[{index}]")


def _joined(path: str | Column, more: str | Column) -> str | Column:
    if isinstance(path, str) and isinstance(more, str):
        return path + more
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in (path, more)])


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass
class Rule:
    """A rule of one place: broken or not, and what to say."""

    keyword: str
    broken: Column
    message: Callable[[], Column]


@dataclass
class Part:
    """A sub-schema at one other place, or at the same one; ``given`` says whether it applies."""

    suffix: str
    place: Place
    given: Column | None
    schema: Schema


@dataclass
class Each:
    """A sub-schema for every element of a list; ``at`` makes the place of an element."""

    suffix: str
    elements: Column
    at: Callable[[Column], Place]
    schema: Schema


def _sequence(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))


class Compiler:
    """Rules of one schema document; ``root`` is where references lead."""

    def __init__(self, root: Schema):
        self.root = root

    def resolved(self, reference: str) -> Schema:
        return resolve(self.root, reference)

    def rules(self, schema: dict, place: Place) -> Iterator[Rule]:
        def about(words: str) -> Callable[[], Column]:
            return lambda: F.concat(place.shown(), F.lit(words))

        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            hit = place.is_a(names[0])
            for name in names[1:]:
                hit = hit | place.is_a(name)
            yield Rule("type", ~hit, about(f" is not of type {', '.join(map(repr, names))}"))
        for key in schema.get("required", []):
            lacking = place.is_a("object") & place.child(key).value.isNull()
            yield Rule("required", lacking, lambda key=key: F.lit(f"{key!r} is a required property"))
        for key, others in schema.get("dependentRequired", {}).items():
            for other in others:
                lacking = place.child(key).value.isNotNull() & place.child(other).value.isNull()
                yield Rule("dependentRequired", lacking, lambda a=other, b=key: F.lit(f"{a!r} is a dependency of {b!r}"))
        if schema.get("additionalProperties", True) is False:
            extras, patterns = _extras(schema, place), schema.get("patternProperties", {})
            quoted = F.concat(F.lit("'"), F.array_join(F.sort_array(extras), "', '"), F.lit("'"))
            one = F.size(extras) == 1
            if patterns:
                verb, rest = F.when(one, " does").otherwise(" do"), f" not match any of the regexes: {', '.join(map(repr, patterns))}"
                message = F.concat(quoted, verb, F.lit(rest))
            else:
                verb = F.when(one, " was").otherwise(" were")
                message = F.concat(F.lit("Additional properties are not allowed ("), quoted, verb, F.lit(" unexpected)"))
            yield Rule("additionalProperties", F.size(extras) > 0, lambda: message)
        if "enum" in schema:
            yield Rule("enum", ~place.equals_one(schema["enum"]), about(f" is not one of {schema['enum']!r}"))
        if "const" in schema:
            yield Rule("const", ~place.equals_one([schema["const"]]), lambda: F.lit(f"{schema['const']!r} was expected"))
        yield from self.limits(schema, place, about)
        yield from self.combined(schema, place, about)

    def limits(self, schema: dict, place: Place, about: Callable) -> Iterator[Rule]:
        bounds = {
            "minimum": (lambda n, x: n < x, " is less than the minimum of "),
            "maximum": (lambda n, x: n > x, " is greater than the maximum of "),
            "exclusiveMinimum": (lambda n, x: n <= x, " is less than or equal to the minimum of "),
            "exclusiveMaximum": (lambda n, x: n >= x, " is greater than or equal to the maximum of "),
            "multipleOf": (lambda n, x: (n / x) != F.floor(n / x), " is not a multiple of "),
        }
        for keyword, (outside, words) in bounds.items():
            if keyword in schema:
                bound = schema[keyword]
                broken = place.is_a("number") & outside(place.number, F.lit(float(bound)))
                yield Rule(keyword, broken, about(f"{words}{bound!r}"))
        sizes = {
            "Length": ("string", lambda: F.length(place.text), "is too short", "is too long"),
            "Items": ("array", lambda: F.size(place.array), "is too short", "is too long"),
            "Properties": ("object", lambda: F.size(place.keys), "does not have enough properties", "has too many properties"),
        }
        for suffix, (kind, size, few, many) in sizes.items():
            if (n := schema.get(f"min{suffix}")) is not None:
                words = "should be non-empty" if n == 1 else few
                yield Rule(f"min{suffix}", place.is_a(kind) & (size() < n), about(f" {words}"))
            if (n := schema.get(f"max{suffix}")) is not None:
                words = "is expected to be empty" if n == 0 else many
                yield Rule(f"max{suffix}", place.is_a(kind) & (size() > n), about(f" {words}"))
        if "pattern" in schema:
            wanted = schema["pattern"]
            yield Rule("pattern", place.is_a("string") & ~place.text.rlike(wanted), about(f" does not match {wanted!r}"))
        if schema.get("uniqueItems"):
            texts = F.transform(place.array, _identity)
            broken = place.is_a("array") & (F.size(F.array_distinct(texts)) < F.size(texts))
            yield Rule("uniqueItems", broken, about(" has non-unique elements"))
        if schema.get("items") is False:
            before = len(schema.get("prefixItems", []))
            more = F.size(place.array) - before
            rest = F.transform(F.slice(place.array, before + 1, F.greatest(more, F.lit(0))), lambda v: F.to_json(v))
            shown = F.when(more == 1, F.array_join(rest, ", ")).otherwise(F.concat(F.lit("["), F.array_join(rest, ","), F.lit("]")))
            words = f"Expected at most {before} {'item' if before == 1 else 'items'} but found "
            yield Rule("items", place.is_a("array") & (more > 0), lambda: F.concat(F.lit(words), more.cast("string"), F.lit(" extra: "), shown))

    def combined(self, schema: dict, place: Place, about: Callable) -> Iterator[Rule]:
        if "anyOf" in schema:
            some = self.holds(schema["anyOf"][0], place)
            for inner in schema["anyOf"][1:]:
                some = some | self.holds(inner, place)
            yield Rule("anyOf", ~some, about(" is not valid under any of the given schemas"))
        if "oneOf" in schema:
            ok = [self.holds(inner, place) for inner in schema["oneOf"]]
            valid = F.filter(F.array(*[F.when(c, repr(s)) for c, s in zip(ok, schema["oneOf"], strict=True)]), lambda s: s.isNotNull())
            count = sum((c.cast("int") for c in ok), F.lit(0))
            yield Rule("oneOf", count == 0, about(" is not valid under any of the given schemas"))

            def each() -> Column:
                later = F.slice(valid, 2, F.greatest(F.size(valid) - 1, F.lit(0)))
                listed = F.array_join(F.concat(later, F.slice(valid, 1, 1)), ", ")
                return F.concat(place.shown(), F.lit(" is valid under each of "), listed)

            yield Rule("oneOf", count > 1, each)
        if "not" in schema:
            yield Rule("not", self.holds(schema["not"], place), about(f" should not be valid under {schema['not']!r}"))
        if "contains" in schema:
            found = F.size(F.filter(place.array, lambda v: self.holds(schema["contains"], Place(v, ""))))
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            is_list = place.is_a("array")
            if least > 0:
                none, few = is_list & (found == 0), is_list & (found > 0) & (found < least)
                yield Rule("contains", none, about(" does not contain items matching the given schema"))
                yield Rule("contains", few, lambda: F.concat(
                    F.lit(f"Too few items match the given schema (expected at least {least} but only "), found.cast("string"), F.lit(" matched)")))
            if most is not None:
                many = F.lit(f"Too many items match the given schema (expected at most {most})")
                yield Rule("contains", is_list & (found > most), lambda: many)

    def parts(self, schema: dict, place: Place) -> Iterator[Part]:
        if "$ref" in schema:
            yield Part("", place, None, self.resolved(schema["$ref"]))
        for i, inner in enumerate(schema.get("allOf", [])):
            yield Part(f".allOf[{i}]", place, None, inner)
        if "if" in schema:
            holds = self.holds(schema["if"], place) if {"then", "else"} & schema.keys() else None
            if "then" in schema:
                yield Part(".then", place, holds, schema["then"])
            if "else" in schema:
                yield Part(".else", place, ~holds, schema["else"])
        for key, inner in schema.get("properties", {}).items():
            below = place.child(key)
            yield Part(f".properties.{key}", below, below.value.isNotNull(), inner)
        for key, inner in schema.get("dependentSchemas", {}).items():
            yield Part(f".dependentSchemas.{key}", place, place.child(key).value.isNotNull(), inner)
        for i, inner in enumerate(schema.get("prefixItems", [])):
            below = place.item(i)
            yield Part(f".prefixItems[{i}]", below, below.value.isNotNull(), inner)

    def lists(self, schema: dict, place: Place) -> Iterator[Each]:
        def of_key(key: Column) -> Place:
            return Place(F.element_at(place.object, key), _joined(_joined(place.path, "."), key))

        for pattern, inner in schema.get("patternProperties", {}).items():
            yield Each(f".patternProperties.{pattern}", F.filter(place.keys, _fits(pattern)), of_key, inner)
        if isinstance(schema.get("additionalProperties", True), dict):
            yield Each(".additionalProperties", F.sort_array(_extras(schema, place)), of_key, schema["additionalProperties"])
        if "propertyNames" in schema:
            yield Each(".propertyNames", place.keys, lambda k: Place(k.cast("variant"), place.path), schema["propertyNames"])
        if isinstance(schema.get("items", True), dict):
            before = len(schema.get("prefixItems", []))
            places = F.filter(_sequence(F.size(place.array)), lambda i: i >= before) if before else _sequence(F.size(place.array))

            def of_index(i: Column) -> Place:
                return Place(F.get(place.array, i), _joined(place.path, F.concat(F.lit("["), i.cast("string"), F.lit("]"))))

            yield Each(".items", places, of_index, schema["items"])

    def holds(self, schema: Schema, place: Place) -> Column:
        """Whether a sub-schema is valid at a place, never NULL."""
        if isinstance(schema, bool):
            return F.lit(schema)
        checks = [~_sure(rule.broken) for rule in self.rules(schema, place)]
        for part in self.parts(schema, place):
            inner = self.holds(part.schema, part.place)
            checks.append(inner if part.given is None else ~part.given | inner)
        for each in self.lists(schema, place):
            checks.append(F.coalesce(F.forall(each.elements, self._holds_at(each)), F.lit(True)))
        found = checks[0] if checks else F.lit(True)
        for check in checks[1:]:
            found = found & check
        return found

    def _holds_at(self, each: Each) -> Callable[[Column], Column]:
        return lambda e: self.holds(each.schema, each.at(e))

    def _wrong_at(self, each: Each, rule: str) -> Callable[[Column], Column]:
        return lambda e: self.every(each.schema, each.at(e), rule)

    def wrong(self, schema: Schema, place: Place, rule: str = "$", given: Column | None = None) -> tuple[list[Column], list[Column]]:
        """What is wrong, as nullable violations and as arrays of them (of lists)."""

        def violation(path: str, broken: Column, message: Column, n: int = 0) -> Column:
            where = F.lit(place.path) if isinstance(place.path, str) else place.path
            entry = F.struct(where.alias("path"), F.lit(path).alias("schema_path"), F.lit(n).alias("n"), message.alias("message"))
            return F.when(_sure(broken if given is None else given & broken), entry)

        if isinstance(schema, bool):
            words = F.lit("False schema does not allow ")
            return ([] if schema else [violation(rule, F.lit(True), F.concat(words, place.shown()))]), []
        single = [violation(f"{rule}.{r.keyword}", r.broken, r.message(), n) for n, r in enumerate(self.rules(schema, place))]
        listed: list[Column] = []
        for part in self.parts(schema, place):
            applies = part.given if given is None else given if part.given is None else given & part.given
            ones, many = self.wrong(part.schema, part.place, rule + part.suffix, applies)
            single += ones
            listed += many
        for each in self.lists(schema, place):
            found = F.flatten(F.transform(each.elements, self._wrong_at(each, rule + each.suffix)))
            listed.append(found if given is None else F.when(given, found))
        return single, listed

    def every(self, schema: Schema, place: Place, rule: str = "$") -> Column:
        """All violations as one array; rules that hold leave a NULL in it."""
        single, listed = self.wrong(schema, place, rule)
        kind = f"array<{VIOLATION}>"
        own = F.array(*single).cast(kind) if single else F.array().cast(kind)
        return F.concat(own, *[F.coalesce(m.cast(kind), F.array().cast(kind)) for m in listed])


def _fits(pattern: str, wanted: bool = True) -> Callable[[Column], Column]:
    return (lambda k: k.rlike(pattern)) if wanted else (lambda k: ~k.rlike(pattern))


def _identity(value: Column) -> Column:
    """Equal for equal JSON values: numbers by their double, the rest by its text."""
    number = F.try_variant_get(value, "$", "double")
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number.cast("string")).otherwise(F.to_json(value))


def _extras(schema: dict, place: Place) -> Column:
    """Keys that neither ``properties`` nor ``patternProperties`` name."""
    named = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
    extras = F.array_except(place.keys, named)
    for pattern in schema.get("patternProperties", {}):
        extras = F.filter(extras, _fits(pattern, False))
    return extras


# --- the schema as a document ---------------------------------------------------------

_ONE = ("additionalProperties", "items", "contains", "propertyNames", "not", "if", "then", "else")
_SEVERAL = ("allOf", "anyOf", "oneOf", "prefixItems")
_NAMED = ("properties", "patternProperties", "dependentSchemas")


def resolve(root: Schema, reference: str) -> Schema:
    """The schema that a local reference (``#`` and a JSON pointer, or an anchor) names."""
    if not reference.startswith("#"):
        raise ValueError(f"unsupported JSON schema reference: {reference}")
    if reference[1:2] not in ("", "/"):
        for schema in _all(root):
            if isinstance(schema, dict) and schema.get("$anchor") == reference[1:]:
                return schema
        raise ValueError(f"unknown JSON schema reference: {reference}")
    found = root
    for part in reference[2:].split("/") if len(reference) > 1 else []:
        key = part.replace("~1", "/").replace("~0", "~")
        try:
            found = found[int(key)] if isinstance(found, list) else found[key]
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"unknown JSON schema reference: {reference}") from None
    return found


def _inner(schema: Schema) -> list[Schema]:
    """Sub-schemas of a schema, without references."""
    if isinstance(schema, bool):
        return []
    found = [schema[k] for k in _ONE if k in schema]
    found += [s for k in _SEVERAL for s in schema.get(k, [])]
    return found + [s for k in _NAMED for s in schema.get(k, {}).values()]


def _all(schema: Schema) -> Iterator[Schema]:
    yield schema
    named = [] if isinstance(schema, bool) else [s for k in ("$defs", "definitions") for s in schema.get(k, {}).values()]
    for inner in _inner(schema) + named:
        yield from _all(inner)


def check_schema(schema: Schema) -> None:
    """Refuse what would be skipped: keywords that are known but not supported, other types of schemas."""
    for inner in _all(schema):
        if not isinstance(inner, dict | bool):
            raise ValueError(f"a JSON schema is an object or a boolean, not {inner!r}")
        if isinstance(inner, dict) and (unknown := [k for k in UNSUPPORTED if k in inner]):
            raise ValueError(f"unsupported JSON schema keywords: {', '.join(sorted(unknown))}")
        for key in ("anyOf", "oneOf", "allOf"):
            if isinstance(inner, dict) and key in inner and not inner[key]:
                raise ValueError(f"{key} needs a schema")


def is_recursive(root: Schema) -> bool:
    """Whether a reference leads to a schema that holds it."""
    done: set[int] = set()

    def visit(schema: Schema, open_: tuple[int, ...]) -> bool:
        if id(schema) in open_:
            return True
        if id(schema) in done or isinstance(schema, bool):
            return False
        inner = _inner(schema) + ([resolve(root, schema["$ref"])] if "$ref" in schema else [])
        found = any(visit(s, (*open_, id(schema))) for s in inner)
        done.add(id(schema))
        return found

    return visit(root, ())
