"""Listing, resolving and walking flattened trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def inventory(files: DataFrame, root: str) -> DataFrame:
    """Files (``path``, ``size``) and the folders above them as inventory rows.

    Folders are the distinct ancestors of the files: their paths are exploded
    and reduced before the shuffle, so a folder with very many files is cheap.
    """
    f = files.select("path", F.col("size").cast("bigint").alias("size"))
    above = F.slice(S.ancestors(F.col("path")), F.lit(2), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    folders = f.select(F.explode(above).alias("path")).distinct().select("path", F.lit(None).cast("bigint").alias("size"), F.lit("folder").alias("type"))
    rows = f.withColumn("type", F.lit("file")).unionByName(folders)
    return rows.select(
        F.lit(root).alias("root"), "path", S.parent_path(F.col("path")).alias("parent"), S.base_name(F.col("path")).alias("name"), "type", "size",
        S.depth_of(F.col("path")).alias("depth"),
    )


def list_children(items: DataFrame, path: str, root: str = "owned") -> DataFrame:
    """Name and type of what a folder holds; nothing for an empty folder, a file or a path that isn't there."""
    at = "/".join(p for p in path.split("/") if p)
    readable = S.is_readable_file(F.col("type"), F.col("size"), F.lit(True))
    return items.where((F.col("root") == root) & (F.col("parent") == at)).select("name", S.type_label(readable).alias("type"))


def list_shared_roots(items: DataFrame) -> DataFrame:
    return list_children(items, "", "shared")


def resolve_paths(requests: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Each request (``request``) with the item it names: the owned tree's, else the shared one's.

    Adds ``path``, ``root``, ``type``, ``size`` and ``status`` ("found" or "not
    found"). The empty path is the owned root. ``strict`` raises instead.
    """
    asked = requests.withColumn("path", S.clean_path(F.col("request")))
    have = items.select("path", "root", "type", "size")
    owned = have.where("root = 'owned'").select("path", F.struct("root", "type", "size").alias("owned"))
    shared = have.where("root = 'shared'").select("path", F.struct("root", "type", "size").alias("shared"))
    found = asked.join(owned, "path", "left").join(shared, "path", "left").withColumn("item", F.coalesce("owned", "shared"))
    is_root = F.col("path") == ""
    ok = is_root | F.col("item").isNotNull()
    status = F.when(ok, "found")
    if strict:
        status = status.otherwise(F.raise_error(F.concat(F.lit("Path not found: "), "request")))
    else:
        status = status.otherwise("not found")
    pick = lambda c, root: F.when(is_root, root).otherwise(F.col(f"item.{c}")).alias(c)
    return found.select("request", "path", pick("root", "owned"), pick("type", "folder"), F.col("item.size").alias("size"), status.alias("status"))


def walk(items: DataFrame, start: str = "", root: str = "owned") -> DataFrame:
    """What lies below ``start``, with its distance ``level``.

    An item is reached if every folder between ``start`` and it is there. That is
    decided for the distinct parents, whose ancestors are looked up among the
    folders; items are joined with their parents once, whatever the depth. Of
    repeated items each is kept.
    """
    at = "/".join(p for p in start.split("/") if p)
    base = at.count("/") + 1 if at else 0
    slim = items.where(F.col("root") == root).select("path", "parent", "type")
    below = slim.where(F.lit(True) if not at else (F.col("parent") == at) | F.startswith("parent", F.lit(at + "/")))
    parents = below.select("parent").distinct()
    # The folders on the way from ``start``, which needs no row of its own, to the parent and the parent itself.
    between = F.filter(S.ancestors(F.col("parent")), lambda a: (a != ".") & (a != "") & (S.depth_of(a) > base))
    folders = slim.where("type = 'folder'").select(F.col("path").alias("above")).distinct()
    way = parents.withColumn("n", F.size(between)).select("parent", "n", F.explode_outer(between).alias("above"))
    whole = way.join(folders.withColumn("there", F.lit(1)), "above", "left").groupBy("parent", "n").agg(F.count("there").alias("have"))
    reached = whole.where("have = n").select("parent")
    level = (S.depth_of(F.col("path")) - base).cast("int")
    return below.join(reached, "parent").select("path", "type", level.alias("level"))


def once_each(items: DataFrame) -> DataFrame:
    """One row a path, as a path that is being processed isn't begun again."""
    return items.dropDuplicates(["root", "path"])


def readable_files(items: DataFrame, openable: Column | None = None) -> DataFrame:
    return items.where(S.is_readable_file(F.col("type"), F.col("size"), F.lit(True) if openable is None else openable))


def listing_events(items: DataFrame, requests: DataFrame) -> DataFrame:
    """What is logged when the paths of ``requests`` (``request``) are listed: ``request``, ``level`` and ``body`` (JSON).

    A folder's contents, an empty folder, a file, or a path that isn't there.
    """
    found = resolve_paths(requests, items)
    readable = S.is_readable_file(F.col("type"), F.col("size"), F.lit(True))
    entry = F.struct("name", S.type_label(readable).alias("type"))
    held = items.groupBy("root", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("contents"))
    j = found.join(held, ["root", "path"], "left")
    say = lambda e, *more: F.to_json(F.struct(F.lit(e).alias("event"), F.col("request").alias("path"), *more))
    missing, file = F.col("status") != "found", F.col("type") == "file"
    body = (
        F.when(missing, say("listing_error", F.concat(F.lit("Path not found: "), "request").alias("error")))
        .when(file, say("item_info", F.lit("file").alias("type"))).when(F.col("contents").isNull(), say("empty_directory")).otherwise(say("listing_contents", F.col("contents")))
    )
    return j.select("request", F.when(missing, "ERROR").otherwise("INFO").alias("level"), body.alias("body"))


def shared_listing_event(items: DataFrame) -> DataFrame:
    """What is logged when the shared roots are listed: one row, ``level`` and ``body``."""
    readable = S.is_readable_file(F.col("type"), F.col("size"), F.lit(True))
    roots = items.where("root = 'shared' AND parent = ''").agg(F.array_sort(F.collect_list(F.struct("name", S.type_label(readable).alias("type")))).alias("contents"))
    none = F.to_json(F.struct(F.lit("no_shared_items").alias("event")))
    some = F.to_json(F.struct(F.lit("listing_shared_roots").alias("event"), F.col("contents")))
    return roots.select(F.lit("INFO").alias("level"), F.when(F.size("contents") == 0, none).otherwise(some).alias("body"))
