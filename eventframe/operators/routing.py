"""Replication routes: parsing, defaults, consistency, and routing of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical
from ..session import hint_small

ROUTE = T.StructType([T.StructField(n, T.StringType()) for n in ("account", "stack", "destination")])


class RouteError(ValueError):
    """Replication settings that cannot be used."""


def role_pattern(role: str) -> str:
    """Pattern of a role name in a destination address; groups: account, stack."""
    return rf"arn:aws:iam::(.*):role/(.*)-{role}"


def destinations(addresses: DataFrame, role: str) -> DataFrame:
    """First address per account and stack; malformed ones are left out.

    ``addresses``: pos, address.
    """
    pattern = role_pattern(role)
    parsed = addresses.select(
        "pos",
        F.trim("address").alias("address"),
        F.regexp_extract("address", pattern, 1).alias("account"),
        F.regexp_extract("address", pattern, 2).alias("stack"),
    ).filter((F.col("account") != "") & (F.col("stack") != ""))
    return parsed.groupBy("account", "stack").agg(
        F.min_by("address", "pos").alias("address"), F.min("pos").alias("pos")
    )


def is_json_array(mapping: Column) -> Column:
    """True for an array, false for other JSON, null for text that is not JSON."""
    parsed = F.try_parse_json(mapping)
    return F.when(parsed.isNotNull(), F.schema_of_variant(parsed).startswith("ARRAY"))


def routes(mappings: DataFrame, account: str, stack: str) -> DataFrame:
    """Resolved routes of mapping texts.

    An entry is a queue name or an object whose first key is the queue; missing
    parts come from the default ``account`` and ``stack``. ``mappings``: pos, mapping.
    """
    entries = mappings.select(
        "pos", F.posexplode(F.from_json("mapping", T.ArrayType(T.StringType()))).alias("entry_pos", "_entry")
    )
    first = F.get(F.map_entries(F.from_json("_entry", T.MapType(T.StringType(), ROUTE))), F.lit(0))
    entries = entries.withColumn("_first", F.when(F.col("_entry").startswith("{"), first))
    source = F.coalesce(F.col("_first.key"), F.col("_entry"))

    def part(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(f"_first.value.{name}"), F.lit("")), default)

    return entries.select(
        "pos",
        "entry_pos",
        source.alias("source"),
        part("account", F.lit(account)).alias("account"),
        part("stack", F.lit(stack)).alias("stack"),
        part("destination", source).alias("destination"),
    )


def default_destination(found: DataFrame) -> tuple[str, str]:
    """Account and stack of the first destination."""
    row = found.orderBy("pos").select("account", "stack").first()
    if row is None:
        raise RouteError("no destination is the address of a role")
    return row["account"], row["stack"]


def unmatched(route_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Routes without a destination and destinations without a route."""
    keys = ["account", "stack"]
    missing = route_rows.select(*keys).distinct().join(found, keys, "left_anti")
    unused = found.select(*keys).join(route_rows, keys, "left_anti")
    return missing.withColumn("problem", F.lit("route without destination")).unionByName(
        unused.withColumn("problem", F.lit("destination without route"))
    )


def checked_routes(mappings: DataFrame, addresses: DataFrame, role: str) -> DataFrame:
    """Routes with their destination address, or an error naming the bad setting."""
    found = destinations(addresses, role)
    account, stack = default_destination(found)
    shape = is_json_array(F.col("mapping"))
    if not mappings.filter(shape.isNull()).isEmpty():
        raise RouteError("the replication mapping cannot be read as JSON")
    if not mappings.filter(~shape).isEmpty():
        raise RouteError("the replication mapping is not a list")
    resolved = routes(mappings, account, stack)
    if not unmatched(resolved, found).isEmpty():
        raise RouteError("routes and destinations name different accounts or stacks")
    return resolved.join(found.select("account", "stack", "address"), ["account", "stack"])


def replication_bots(route_rows: DataFrame) -> DataFrame:
    """One bot document per route."""
    bot = F.concat(
        F.lit("replicate-"), "source", F.lit("-to-"), "account", F.lit("-"), "stack", F.lit("-"), "destination"
    )
    return route_rows.select(
        bot.alias("id"), F.array("source").alias("triggers"), "source", "destination", "account", "stack",
        *[c for c in ("address",) if c in route_rows.columns],
    )


def route_events(events: DataFrame, route_rows: DataFrame) -> DataFrame:
    """Each event once per distinct route of its queue."""
    table = route_rows.select(canonical(F.col("source")).alias("queue"), "account", "stack", "destination").distinct()
    return events.join(hint_small(table), "queue")


def registry_items(resources: DataFrame, ignored: list[str]) -> DataFrame:
    """(key, value) rows of a map column without the ignored keys."""
    kept = F.map_filter("items", lambda k, _: ~k.isin(ignored))
    return resources.select(*[c for c in resources.columns if c != "items"], F.explode(kept).alias("key", "value"))
