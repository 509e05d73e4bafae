"""Block graphs within one payload: blocks by their ids, without a join. A payload is one document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to as many ids are looked through one by one; beyond, ids are halved.
FEW = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(payload: Column, name: str, shape: str) -> Column:
    """What a payload holds under a name at its top, read in one go; an object where a list belongs is a list of it."""
    return F.coalesce(F.from_json(payload, f"struct<{name}:{shape}>")[name], F.from_json(F.get_json_object(payload, f"$.{name}"), shape))


def joined(lists: Column) -> Column:
    """Lists in one; those that are null count as empty."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def indexed(blocks: Column, use: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """use(index) with the blocks (structs whose first field is Id) that have an id (and that ``keep`` is true for), by id."""
    some = F.filter(blocks, lambda b: b["Id"].isNotNull() if keep is None else b["Id"].isNotNull() & keep(b))
    ids = lambda b: F.transform(b, lambda x: x["Id"])
    whole = lambda b, i: F.struct(b.alias("blocks"), i.alias("ids"), (F.size(F.array_distinct(i)) == F.size(i)).alias("once"))
    return once(F.sort_array(some), lambda b: once(ids(b), lambda i: once(whole(b, i), use)))


def _bound(ids: Column, name: Column, after: bool) -> Column:
    """How many ids come before the name, or before what follows it."""
    below = (lambda x: x <= name) if after else (lambda x: x < name)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ids) + 1)).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        part = lambda m: F.when(below(F.get(ids, m)), F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))
        return F.when(a["lo"] < a["hi"], once(middle, part)).otherwise(a)

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ids).alias("hi")), halve)["lo"]


def found(index: Column, name: Column) -> Column:
    """The blocks of the index with the id; none for null."""
    blocks, ids = index["blocks"], index["ids"]
    halved = once(_bound(ids, name, False), lambda at: F.slice(blocks, at + 1, _bound(ids, name, True) - at))
    at = F.array_position(ids, name).cast("int")
    same = lambda k: F.when(k > 0, F.when(index["once"], F.slice(blocks, k, 1)).otherwise(F.filter(blocks, lambda b: b["Id"] == name)))
    some = F.when(name.isNotNull(), F.when(F.size(ids) <= FEW, once(at, same)).otherwise(halved))
    return F.coalesce(some, F.slice(blocks, 1, 0))


def kids(blocks: Column, kind: str = "CHILD") -> Column:
    """k and Id of what blocks lead to."""
    links = joined(F.transform(blocks, lambda b: F.filter(b["Relationships"], lambda r: r["Type"] == kind)))
    return joined(F.transform(links, lambda r: F.transform(r["Ids"], lambda i, k: F.struct(k.alias("k"), i.alias("Id")))))


def words(own: Column, index: Column, word: Callable[[Column], Column]) -> Column:
    """The joined words (of the blocks of the index) that blocks lead to; null if they lead to none."""
    at = joined(F.transform(kids(own), lambda x: F.transform(found(index, x["Id"]), lambda b: F.struct(x["k"].alias("k"), word(b).alias("t")))))
    return once(at, lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(F.sort_array(a), lambda x: x["t"]), " ")))
