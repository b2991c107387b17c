"""Named DataFrames of the bank, from stored tables or from the mapped test data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bankspark.sources import dims, mapping, schemas


class _Dimensions:
    """Code tables shared by every source of facts."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._dims: dict[str, DataFrame] = {}

    def dim(self, name: str) -> DataFrame:
        if name not in self._dims:
            self._dims[name] = dims.dimension(self.spark, name)
        return self._dims[name]

    @property
    def product_statuses(self) -> DataFrame:
        return self.dim("product_statuses")

    @property
    def product_categories(self) -> DataFrame:
        return self.dim("product_categories")

    @property
    def product_subcategories(self) -> DataFrame:
        return self.dim("product_subcategories")

    @property
    def user_roles(self) -> DataFrame:
        return self.dim("user_roles")

    @property
    def verifications(self) -> DataFrame:
        return self.dim("verifications")

    @property
    def account_groups(self) -> DataFrame:
        return self.dim("account_groups")

    @property
    def currencies(self) -> DataFrame:
        return self.dim("currencies")

    @property
    def next_status(self) -> DataFrame:
        return self.dim("next_status")

    @property
    def progression(self) -> DataFrame:
        return self.dim("progression")


class Tables(_Dimensions):
    """Facts given as DataFrames by name; code tables fall back to the seeded ones."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        super().__init__(spark)
        for name, df in tables.items():
            if name in dims.DIMENSION_NAMES:
                self._dims[name] = df
            else:
                setattr(self, name, df)

    def replace(self, **tables: DataFrame) -> "Tables":
        """The same tables with some exchanged, e.g. for the next snapshot."""
        current = {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}
        return Tables(self.spark, **{**self._dims, **current, **tables})


def load_tables(spark: SparkSession, directory: str, fmt: str = "parquet") -> Tables:
    """Every bank table found as ``directory/<table>``, read with its declared schema."""
    found = {}
    for name, schema in schemas.TABLES.items():
        path = f"{directory}/{name}"
        if _exists(spark, path):
            found[name] = spark.read.format(fmt).schema(schema).load(path)
    return Tables(spark, **found)


def load_tables_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    split_on: dict[str, tuple[str, int, int, int]] | None = None,
) -> Tables:
    """The same tables from a relational database.

    ``split_on`` gives (key column, lowest, highest, number of reads) per table, so that a big
    table arrives in parallel slices. It is needed for every table that grows; one connection
    reads only the code lists.
    """
    missing = [name for name in schemas.TABLES if name not in dims.DIMENSION_NAMES and name not in (split_on or {})]
    if missing:
        raise ValueError("split_on is needed for " + ", ".join(missing))
    found = {}
    for name in schemas.TABLES:
        if split_on and name in split_on:
            column, low, high, parts = split_on[name]
            found[name] = spark.read.jdbc(
                url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts,
                properties=properties,
            )
        else:
            found[name] = spark.read.jdbc(url, name, properties=properties)
    return Tables(spark, **found)


def write_snapshot(df: DataFrame, directory: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write one version of a table; a rerun of the same version replaces it."""
    path = f"{directory}/version={version}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def latest_version(spark: SparkSession, directory: str, before: int | None = None) -> int | None:
    """Newest finished version under ``directory``, or the newest one older than ``before``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if name.startswith("version=") and done:
            versions.append(int(name.split("=", 1)[1]))
    if before is not None:
        versions = [v for v in versions if v < before]
    return max(versions, default=None)


# Facts that join by product_uid.
BY_INSTANCE = ("product_instances", "product_status_updates", "product_custom_column_values")


def store_bucketed(db: "Tables", database: str, buckets: int, names: tuple[str, ...] = BY_INSTANCE) -> None:
    """Save facts as catalog tables bucketed and sorted by ``product_uid``.

    Joins and groupings on ``product_uid`` between tables with the same number of buckets then read
    matching buckets and shuffle nothing. Choose ``buckets`` so that one holds a few hundred MB.
    """
    for name in names:
        df = getattr(db, name)
        (df.repartition(buckets, "product_uid").write.mode("overwrite").format("parquet")
         .bucketBy(buckets, "product_uid").sortBy("product_uid").saveAsTable(f"{database}.{name}"))


def load_bucketed(spark: SparkSession, database: str, names: tuple[str, ...] = BY_INSTANCE) -> dict[str, DataFrame]:
    """The tables saved by ``store_bucketed``, to put into ``Tables``."""
    return {name: spark.table(f"{database}.{name}") for name in names}


def append_rows(df: DataFrame, directory: str) -> None:
    """Append sink, e.g. for the audit log."""
    df.write.mode("append").parquet(directory)


def read_menu(spark: SparkSession, path: str) -> DataFrame:
    """Nested portal menu from a JSON document."""
    return spark.read.schema(schemas.MENU).json(path, multiLine=True)


def menu_for_role(menu: DataFrame, role: str) -> DataFrame:
    """Menu entries a role may see: groups that name the role, children that name it or no role."""
    child_ok = F.col("child.privileges").isNull() | F.array_contains("child.privileges", role)
    return (
        menu.filter(F.array_contains("privileges", role))
        .select("displayName", "dataGroup", F.posexplode("children").alias("pos", "child"))
        .filter(child_ok)
        .select(
            F.col("displayName").alias("group_name"),
            F.col("dataGroup").alias("data_group"),
            F.col("pos").cast(T.LongType()).alias("pos"),
            F.col("child.displayName").alias("child_name"),
            F.col("child.url").alias("url"),
        )
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


class MappedTables(_Dimensions):
    """Bank tables mapped from the star-schema test tables; each is built when first used."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__(spark)
        self.directory = directory
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        path = f"{self.directory}/{name}.parquet"
        return self._frame("raw." + name, lambda: self.spark.read.schema(schemas.RAW[name]).parquet(path))

    def view(self, name: str) -> DataFrame:
        if name not in mapping.VIEWS:
            return self.raw(name)
        return self._frame(name, lambda: self._build(name))

    def _frame(self, key: str, build) -> DataFrame:
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def _build(self, name: str) -> DataFrame:
        sources = {ref: self.view(ref) for ref in mapping.references(name)}
        return self.spark.sql(mapping.spark_view(name), **sources)

    def over(self, **tables: DataFrame) -> "MappedTables":
        """The same mapping with some views or raw tables exchanged."""
        other = MappedTables(self.spark, self.directory)
        other._frames.update({("raw." + k if k in mapping.RAW_TABLES else k): v for k, v in tables.items()})
        return other

    def replace(self, **tables: DataFrame) -> "MappedTables":
        other = MappedTables(self.spark, self.directory)
        other._frames.update(self._frames)
        other._dims.update(self._dims)
        for name, df in tables.items():
            if name in schemas.TABLES and name not in mapping.VIEWS and name not in dims.DIMENSION_NAMES:
                setattr(other, name, df)  # a table that the test data cannot give
            else:
                (other._dims if name in dims.DIMENSION_NAMES else other._frames)[name] = df
        return other

    @cached_property
    def accounts(self) -> DataFrame:
        return self.view("accounts")

    @cached_property
    def products(self) -> DataFrame:
        return self.view("products")

    @cached_property
    def applications(self) -> DataFrame:
        return self.view("applications")

    @cached_property
    def product_instances(self) -> DataFrame:
        return self.view("product_instances")

    @cached_property
    def product_status_updates(self) -> DataFrame:
        return self.view("product_status_updates")

    @cached_property
    def product_custom_column_def(self) -> DataFrame:
        return self.view("product_custom_column_def")

    @cached_property
    def draft_product_custom_column_def(self) -> DataFrame:
        return self.view("draft_product_custom_column_def")

    @cached_property
    def product_custom_column_values(self) -> DataFrame:
        return self.view("product_custom_column_values")
