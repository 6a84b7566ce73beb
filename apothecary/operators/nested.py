"""Flat tables from deeply nested records, by Merkle identities of their subtrees.

Every nested object is brought to a canonical body: its non-null scalar fields as text in
name order, then the places and identities of the objects nested in it. The body's hash is
the object's identity, so hashing runs bottom-up and equal subtrees have equal identities at
any depth. Equal objects are stored once; each place where one stands is kept as a bridge
row from parent to child with its ordinals, so the records can be put together again.

Which fields nest follows from the schema of the typed tables; JSON payloads are read by
the same tree, parsed once.

Defined cases: an element that is NULL or has no non-null field is no object but keeps its
place; a lone object stands at place 1; a list given as JSON text inside a string is read
as that list; broken or non-object payloads and payloads with repeated fields give
nothing; repeated records count once; records without an id are left out; a list of
scalars is a scalar field.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nested lists by name, each with the lists nested in it.
Tree = dict[str, "Tree"]
KEYS = {"ndc": "product_id", "drugsfda": "application_number"}
#: Bytes of SHA-256 that make an identity: two objects among 2 ** 40 share one by chance once in 2 ** 49 such corpora.
ID_BYTES = 16
PLACE = "array<struct<path:string,ordinals:array<int>,object_id:binary,parent_id:binary,body:string>>"


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def tree_of(kind: T.StructType) -> Tree:
    """The nested lists of a record type, to any depth."""
    return {f.name: tree_of(f.dataType.elementType) for f in kind.fields if _is_list(f.dataType)}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(elements: Column, path: str, tree: Tree, present: Callable[[Column], Column], body: Callable[[Column], Column], inner: Callable[[Column, str], Column], read: Callable) -> Column:
    """Places of all objects in and below a list, children before parents in identity, as one array.

    ``present``, ``body`` and ``inner`` tell of an element whether it is an object, its
    scalar fields as text and the places below one of its lists.
    """

    def own(below: Column | None, e: Column, i: Column) -> Column:
        at = F.array((i + 1).cast("int"))
        refs = F.array().cast("array<string>") if below is None else F.transform(F.filter(below, lambda p: p["parent_id"].isNull()), lambda p: F.concat_ws(":", p["path"], F.array_join(p["ordinals"], "."), F.lower(F.hex(p["object_id"]))))

        def with_body(text: Column) -> Column:
            return _let(
                F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", F.lit(path), text, F.array_join(refs, "|")), 256)), 1, ID_BYTES),
                lambda oid: F.concat(
                    F.array(F.struct(F.lit(path).alias("path"), at.alias("ordinals"), oid.alias("object_id"), F.lit(None).cast("binary").alias("parent_id"), text.alias("body"))),
                    F.array().cast(PLACE) if below is None else F.transform(below, lambda p: F.struct(p["path"].alias("path"), F.concat(at, p["ordinals"]).alias("ordinals"), p["object_id"].alias("object_id"), F.coalesce(p["parent_id"], oid).alias("parent_id"), p["body"].alias("body"))),
                ).cast(PLACE),
            )

        return _let(body(e), with_body)

    def one(e: Column, i: Column) -> Column:
        if not tree:
            found = own(None, e, i)
        else:
            lists = [F.coalesce(inner(e, name), F.array().cast(PLACE)) for name in tree]
            found = _let(F.concat(*lists), lambda below: own(below, e, i))
        return F.when(present(e), found).otherwise(F.array().cast(PLACE))

    return F.flatten(F.transform(elements, one))


def _native(elements: Column, kind: T.StructType, path: str) -> Column:
    """Places of a typed list."""
    tree = tree_of(kind)
    fields = {f.name: f.dataType for f in kind.fields}
    text = lambda e, n: e[n].cast("string") if isinstance(fields[n], T.AtomicType) else F.to_json(e[n])
    plain = sorted(n for n in fields if n not in tree)
    body = lambda e: F.to_json(F.struct(*[text(e, n).alias(n) for n in plain])) if plain else F.lit("{}")
    some = lambda e: reduce(lambda a, n: a | e[n].isNotNull(), fields, F.lit(False))
    return _places(elements, path, tree, lambda e: F.coalesce(some(e), F.lit(False)), body, lambda e, n: _native(e[n], kind[n].dataType.elementType, f"{path}.{n}"), _native)


def _whole(text: Column) -> Column:
    """The one JSON value that a text holds, NULL if it holds anything else.

    The parser passes over what follows a value, so the text is set between a list and a
    last field that only this text's own digest names: both must be there.
    """
    mark = F.md5(text)
    parsed = F.try_parse_json(F.concat(F.lit('{"x":['), text, F.lit('],"'), mark, F.lit('":0}')))
    return _let(F.try_variant_get(parsed, "$", "map<string,variant>"), lambda m: _let(F.try_variant_get(m["x"], "$", "array<variant>"), lambda x: F.when((F.size(m) == 2) & m[mark].isNotNull() & (F.size(x) == 1), F.get(x, F.lit(0)))))


def _variant_list(value: Column) -> Column:
    """Elements of a list that may be a lone object, or JSON text of either inside a string."""
    direct = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)))
    return F.coalesce(direct(value), direct(_whole(F.try_variant_get(value, "$", "string"))))


def _raw(elements: Column, tree: Tree, path: str) -> Column:
    """Places of a list of JSON values."""
    fields = lambda e: F.map_filter(F.try_variant_get(e, "$", "map<string,string>"), lambda _, v: v.isNotNull())
    # An object's fields come in name order.
    body = lambda e: F.to_json(F.map_filter(fields(e), lambda k, _: ~k.isin(list(tree)))) if tree else F.to_json(fields(e))
    return _places(elements, path, tree, lambda e: F.coalesce(F.size(fields(e)) > 0, F.lit(False)), body, lambda e, n: _raw(_variant_list(F.try_variant_get(e, f"$.{n}", "variant")), tree[n], f"{path}.{n}"), _raw)


def native_occurrences(df: DataFrame, feed: str, id_col: str) -> DataFrame:
    """feed, record_id, path, ordinals, object_id, parent_id, body of every object in a typed table's nested lists, in one scan."""
    lists = [F.coalesce(_native(F.col(n), df.schema[n].dataType.elementType, n), F.array().cast(PLACE)) for n in tree_of(df.schema)]
    rows = df.where(F.col(id_col).isNotNull()).select(F.lit(feed).alias("feed"), F.col(id_col).cast("string").alias("record_id"), F.explode(F.concat(*lists)).alias("p"))
    return rows.select("feed", "record_id", "p.*")


def raw_occurrences(df: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """The same of JSON payloads; ``feed`` of the table says which lists a payload has."""
    rows = df.where(F.col("raw_id").isNotNull() & F.col("payload").rlike(r"^\s*\{")).withColumn("_v", _whole(F.col("payload")))

    def places(tree: Tree) -> Column:
        return F.concat(*[F.coalesce(_raw(_variant_list(F.try_variant_get(F.col("_v"), f"$.{n}", "variant")), inner, n), F.array().cast(PLACE)) for n, inner in tree.items()])

    feed = F.lower(F.trim("feed"))
    of = reduce(lambda acc, kv: acc.when(feed == kv[0], places(kv[1])), list(trees.items())[1:], F.when(feed == next(iter(trees)), places(next(iter(trees.values())))))
    return rows.select(F.lit("raw_feed").alias("feed"), F.col("raw_id").cast("string").alias("record_id"), F.explode(of).alias("p")).select("feed", "record_id", "p.*")


def all_occurrences(ndc: DataFrame, drugsfda: DataFrame, raw_feed: DataFrame) -> DataFrame:
    """Every place of every object: feed, record_id, path, ordinals, object_id, parent_id, body."""
    tables = {"ndc": ndc, "drugsfda": drugsfda}
    native = [native_occurrences(df, feed, KEYS[feed]) for feed, df in tables.items()]
    return reduce(DataFrame.unionByName, [*native, raw_occurrences(raw_feed, {feed: tree_of(df.schema) for feed, df in tables.items()})])


def objects(occ: DataFrame) -> DataFrame:
    """Each distinct object once: object_id, path, body of its scalar fields, and the number of places where it stands.

    Body and path follow from the identity, so any place tells them; a reader of identities only
    pays for neither.
    """
    return bridge(occ, "body").groupBy("object_id").agg(F.any_value("path").alias("path"), F.any_value("body").alias("body"), F.count(F.lit(1)).alias("places"))


def identities(occ: DataFrame) -> DataFrame:
    """The identities under which objects are stored, each once."""
    return occ.select("object_id").distinct()


def bridge(occ: DataFrame, *more: str) -> DataFrame:
    """Rows from parent to child: the record, path and ordinals of a place, the object in it and the object around it (NULL: the record)."""
    return occ.select("feed", "record_id", "path", "ordinals", "parent_id", "object_id", *more).distinct()


def places(links: DataFrame, stored: DataFrame) -> DataFrame:
    """feed, record_id, path, pos, sub_pos of the bridge rows whose object is stored, each once."""
    return links.join(stored, "object_id", "left_semi").select("feed", "record_id", "path", *_position()).distinct()


def _position() -> list[Column]:
    return [F.get("ordinals", F.lit(0)).cast("bigint").alias("pos"), F.coalesce(F.get("ordinals", F.lit(1)), F.lit(0)).cast("bigint").alias("sub_pos")]


def flat(links: DataFrame, stored: DataFrame) -> DataFrame:
    """The flat tables: one row a place, with the stored object it points to; ``stored`` holds each object once."""
    return links.join(stored.select("object_id", "body"), "object_id").select("feed", "record_id", "path", "ordinals", *_position(), "parent_id", "object_id", "body")
