"""Digests of nested values and readable ids made of them, as built-in expressions.

The canonical form of a value is its JSON with struct fields in order of name, without the keys that
hold paths of one machine; lists keep their order. Digests are SHA-256 in base 36, 12 digits for
every 60 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that name files of the machine that ran an evaluation.
MACHINE_KEYS = frozenset({"name_file_path", "mapping_file_path"})
PREFIX = 25
SHORT = 16


def canonical(c: Column, kind: T.DataType, drop: frozenset[str] = MACHINE_KEYS) -> Column:
    """STR23: ``c`` of type ``kind`` with sorted fields and keys and without those of ``drop``, at any depth; null stays null."""
    if isinstance(kind, T.StructType):
        fields = [canonical(c[f.name], f.dataType, drop).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in drop]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType, drop))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.filter(F.map_entries(c), lambda e: ~e["key"].isin(*drop)) if drop else F.map_entries(c)
        return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType, drop).alias("value"))))
    return c


def canonical_json(c: Column, kind: T.DataType, drop: frozenset[str] = MACHINE_KEYS) -> Column:
    """JSN2: the canonical form as text; fields that are null are left out of it."""
    return F.coalesce(F.to_json(F.struct(canonical(c, kind, drop).alias("v"))), F.lit("{}"))


def base36(text: Column) -> Column:
    """STR23: the SHA-256 of a text in base 36."""
    digest = F.sha2(text, 256)
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 36)), 12, "0") for k in range(5)])


def stable_hash36(c: Column, kind: T.DataType, drop: frozenset[str] = frozenset()) -> Column:
    return base36(canonical_json(c, kind, drop))


def nice_id(raw: Column, digest: Column, keep: int = PREFIX) -> Column:
    """STR24: readable text spliced into a digest, as long as the digest."""
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    head = F.when(F.length(bare) < F.length(digest), bare).otherwise(F.substring(bare, 1, keep))
    return F.concat(head, F.substring(digest, F.lit(1), F.length(digest) - F.length(head)))


def prefixed_id(prefix: Column, digest: Column, short: int = SHORT) -> Column:
    """STR24: a readable prefix, ``::`` and the beginning of a digest."""
    return F.concat(F.replace(prefix, F.lit(" "), F.lit("")), F.lit("::"), F.substring(digest, 1, short))


def hint(c: Column, kind: T.StructType, without: tuple[str, ...], most: int = 70) -> Column:
    """The other fields of a struct as k=v, in order of name and cut at ``most`` characters; empty if all are null."""
    rest = sorted((f.name for f in kind.fields if f.name not in without and f.name not in MACHINE_KEYS and not isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))))
    text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), c[n].cast("string")) for n in rest]) if rest else F.lit("")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def _joined(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with commas."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), ",")


def perturbation_id(c: Column, kind: T.StructType) -> Column:
    """STR24: name, hint and digest of a perturbation; null for none."""
    rest = T.StructType([f for f in kind.fields if f.name != "name"])
    others = F.struct(*[c[f.name].alias(f.name) for f in rest.fields])
    return F.when(c.isNotNull(), prefixed_id(_joined(F.coalesce(F.nullif(c["name"], F.lit("")), F.lit("pert")), hint(c, kind, ("name",))), stable_hash36(others, rest, MACHINE_KEYS)))


def stat_name_id(c: Column, kind: T.StructType, count: Column | None = None) -> Column:
    """STR24: the older form, with the digest's length."""
    raw = _joined(F.coalesce(c["name"], F.lit("nobasename")), hint(c, kind, ("name",), 1 << 20), F.concat(F.lit("count="), count.cast("string")) if count is not None else F.lit(""))
    return nice_id(F.concat(raw, F.lit(",")), _with_count(c, kind, count, frozenset()))


def stat_key(c: Column, kind: T.StructType, count: Column | None = None) -> Column:
    """STR24: metric, other selectors, split, sub-split, perturbation and count, then a digest of all of it."""
    has = {f.name: f.dataType for f in kind.fields}
    part = lambda name, label: F.concat(F.lit(f"{label}="), c[name]) if name in has else F.lit("")
    pert = F.concat(F.lit("pert="), F.substring_index(perturbation_id(c["perturbation"], has["perturbation"]), "::", 1)) if "perturbation" in has else F.lit("")
    number = F.concat(F.lit("count="), count.cast("string")) if count is not None else F.lit("")
    prefix = _joined(F.coalesce(F.nullif(c["name"], F.lit("")), F.lit("stat")), hint(c, kind, ("name", "split", "sub_split", "perturbation")), part("split", "split"), part("sub_split", "sub"), pert, number)
    return prefixed_id(prefix, _with_count(c, kind, count, MACHINE_KEYS))


def _with_count(c: Column, kind: T.StructType, count: Column | None, drop: frozenset[str]) -> Column:
    form = canonical_json(c, kind, drop)
    return base36(form if count is None else F.concat(form, F.lit("#"), F.coalesce(count.cast("string"), F.lit(""))))


def row_id(c: Column, kind: T.DataType, label: str = "row") -> Column:
    """STR24: an id of any row as a struct."""
    return nice_id(F.lit(f"{label},"), stable_hash36(c, kind))
