"""Label matrix semantics: tri-state cells, resolution, placement, filters, splits and balanced sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K

UUID_PATTERN = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def cell(c: Column) -> Column:
    """1, 0 or null; blank, non-numeric and NaN cells are null."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def resolve(rows: DataFrame, columns: dict[str, str] = K.LABEL_COLUMNS, standing: str = "flag") -> DataFrame:
    """Adds ``label``, ``in_subset``, ``positive_labels``, ``missing_labels`` and ``flags``.

    Several positive cells: no label, ``multi_label``; one: its class; none but some missing: no label,
    ``unresolved_missing_label``; none and none missing: outside the subset.  ``standing``: ``flag`` keeps the
    class and flags it, ``unlabeled`` clears it, ``drop`` removes the row.
    """
    if standing not in ("flag", "unlabeled", "drop"):
        raise ValueError("standing must be flag, unlabeled or drop")
    cells = {c: cell(F.col(f"`{c}`")) if c in rows.columns else F.lit(None).cast("double") for c in columns}
    positive = F.array_compact(F.array(*[F.when(v > 0, F.lit(columns[c])) for c, v in cells.items()]))
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(columns[c])) for c, v in cells.items()]))
    out = rows.withColumn("positive_labels", positive).withColumn("missing_labels", missing)
    n = F.size("positive_labels")
    label = F.when(n == 1, F.element_at("positive_labels", 1))
    stands = F.coalesce(label == "standing in place", F.lit(False))
    if standing == "unlabeled":
        label = F.when(stands, None).otherwise(label)
    flags = F.array_compact(F.array(F.when(n > 1, F.lit("multi_label")), F.when((n == 0) & (F.size("missing_labels") > 0), F.lit("unresolved_missing_label")), F.when(stands, F.lit("standing_split_unresolved"))))
    out = out.withColumn("label", label).withColumn("in_subset", (n > 0) | (F.size("missing_labels") > 0)).withColumn("flags", flags)
    return out.where(~F.array_contains("flags", "standing_split_unresolved")) if standing == "drop" else out


def placement(rows: DataFrame, columns: dict[str, str] = K.PLACEMENT_COLUMNS) -> Column:
    """The only placement cell that is 1, else unknown."""
    named = F.array_compact(F.array(*[F.when(cell(F.col(f"`{c}`")) == 1.0, F.lit(p)) for c, p in columns.items() if c in rows.columns]))
    return F.when(F.size(named) == 1, F.element_at(named, 1)).otherwise(F.lit("unknown"))


def ingest(labels: DataFrame, bursts: DataFrame, *, keep_missing: bool = True, drop_ambiguous: bool = False, standing: str = "flag", limit: int | None = None) -> DataFrame:
    """Resolved minutes with their bursts (``uuid, timestamp, acc, gyro``), flags joined.

    Filters come before the join; a missing burst stays as null and is never made up.
    """
    rows = resolve(labels.withColumn("timestamp", F.floor(cell(F.col("timestamp"))).cast("long")), standing=standing).where("in_subset and timestamp is not null")
    if drop_ambiguous:
        rows = rows.where("label is not null")
    joined = rows.join(bursts.withColumn("__b", F.lit(1)), ["uuid", "timestamp"], "left" if keep_missing else "inner")
    more = F.array_compact(F.array(F.when(F.col("__b").isNull(), F.lit("missing_burst")), F.when(F.col("__b").isNotNull() & (F.size("acc") != K.NOMINAL_SAMPLES), F.lit("short_burst")), F.when(F.col("__b").isNotNull() & F.col("gyro").isNull(), F.lit("missing_gyro"))))
    out = joined.withColumn("flags", F.concat("flags", more)).drop("__b")
    return out.orderBy("uuid", "timestamp").limit(limit) if limit else out


def scan(labels: DataFrame, listing: DataFrame) -> DataFrame:
    """Resolved minutes whose burst exists, without reading bursts."""
    return resolve(labels).where("in_subset and label is not null").join(listing, ["uuid", "timestamp"], "left_semi")


def drop_classes(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Class indices stay as they are."""
    return rows.where(~F.col(label).isin(names))


def valid_uuid(c: Column) -> Column:
    """Raises on a malformed user id."""
    return F.when(c.rlike(UUID_PATTERN), c).otherwise(F.raise_error(F.concat(F.lit("not a user id: "), F.coalesce(c, F.lit("null")))))


def split_users(rows: DataFrame, user: str, order: Column, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Disjoint users for train, val and test, dealt by ``order`` with rounded shares (one row per user)."""
    users = rows.select(user).distinct().withColumn("__o", order)
    ranked = users.withColumn("__r", F.row_number().over(W.orderBy("__o", user))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    a = F.floor(F.col("__n") * shares[0] + 0.5)
    b = a + F.floor(F.col("__n") * shares[1] + 0.5)
    return ranked.select(user, F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "val").otherwise("test").alias("split"))


def kfold(rows: DataFrame, user: str, order: Column, k: int) -> DataFrame:
    """A fold number for each user."""
    users = rows.select(user).distinct().withColumn("__o", order)
    return users.select(user, ((F.row_number().over(W.orderBy("__o", user)) - 1) % k).cast("int").alias("fold"))


def balanced_cap(rows: DataFrame, label: str, user: str, order: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows per class, taken round by round over its users; smaller classes stay whole."""
    first = rows.withColumn("__o", order).withColumn("__round", F.row_number().over(W.partitionBy(label, user).orderBy("__o")))
    pick = first.withColumn("__pick", F.row_number().over(W.partitionBy(label).orderBy("__round", user, "__o")))
    return pick.where(F.col("__pick") <= cap).drop("__o", "__pick").withColumnRenamed("__round", "round")
