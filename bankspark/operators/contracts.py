"""Contract texts: facts, clauses, documents and signatures."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from bankspark.functions import columns as C
from bankspark.operators.attributes import attribute_values
from bankspark.operators.ordering import append_with_ids, has_large_group, paged
from bankspark.sources import clauses, dims
from bankspark.sources.tables import Tables

_LAST_ROW = (1 << 63) - 1  # place of the strike date, after all attribute rows


def contract_facts(db: Tables, instances: DataFrame | None = None) -> DataFrame:
    """What a contract says about an instance: parties, address, product and terms."""
    rows = db.product_instances if instances is None else db.product_instances.join(instances, "product_uid", "left_semi")
    rows = rows.select("product_uid", "account_id", "application_id", "amount", "yield", "product_start_date", "product_end_date")
    people = db.accounts.select("account_id", "first_name", "last_name", "address", "country_code")
    products = db.products.select(
        "product_id", "currency", F.col("category_id"), F.col("name").alias("product_name"),
        F.col("description").alias("product_description"),
    )
    return (
        rows.join(people, "account_id")
        .join(db.applications.select("application_id", "product_id"), "application_id").join(products, "product_id")
        .select(
            "product_uid", "currency", "amount", (F.col("yield") * 100).alias("rate_pct"),
            C.long_date(F.col("product_start_date")).alias("begin_date"),
            C.long_date(F.col("product_end_date")).alias("end_date"),
            "first_name", "last_name", C.address_line(F.col("address"), F.col("country_code")).alias("address"),
            "category_id", "product_name", "product_description",
        )
    )


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("None")))
    return F.concat(*parts)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clause_sql(item) -> str:
    """One clause as SQL over the terms of a contract. A DER table always holds the strike date."""
    if item is clauses.TABLE:
        return "named_struct('kind', IF(has_rows OR category_id = 'DER', 'table', 'none'), 'text', CAST(NULL AS STRING))"
    if item is clauses.SALE_DETAILS:
        heading = _quoted(clauses.SALE_DETAILS_TEXT)
        return f"named_struct('kind', IF(has_rows, 'text', 'none'), 'text', IF(has_rows, {heading}, NULL))"
    parts = []
    for text, field, _, _ in Formatter().parse(item):
        parts += [_quoted(text)] * bool(text) + [f"v_{field}"] * bool(field)
    return f"named_struct('kind', 'text', 'text', concat({', '.join(parts)}))"


def _clauses_sql() -> str:
    """The clauses of a contract as an array, chosen by category."""
    def array(items) -> str:
        return "array(" + ", ".join(_clause_sql(item) for item in items) + ")"

    branches = " ".join(f"WHEN '{category}' THEN {array(items)}" for category, items in clauses.BY_CATEGORY.items())
    return f"CASE category_id {branches} ELSE {array(clauses.OTHER)} END"


def _now_text(as_of: dt.date) -> Column:
    return C.long_date(C.day(as_of))


def _has_terms() -> Column:
    """Every contract states a rate, and all but derivatives an amount."""
    needs_amount = F.col("category_id").isin("LON", "PEQ")
    return F.col("rate_pct").isNotNull() & (~needs_amount | F.col("amount").isNotNull())


def _terms(facts: DataFrame, has_rows: Column, as_of: dt.date, bank_name: str, *more: str) -> DataFrame:
    """What the clauses are filled with, for contracts that have the terms they state."""
    values = {
        "now": _now_text(as_of), "bank": F.lit(bank_name), "first_name": F.col("first_name"),
        "last_name": F.col("last_name"), "address": F.col("address"), "currency": F.col("currency"),
        "amount": F.format_string("%.2f", F.col("amount")), "rate": F.format_string("%.2f", F.col("rate_pct")),
        "begin": F.col("begin_date"), "end": F.col("end_date"), "product_uid": F.col("product_uid"),
        "product_name": F.col("product_name"), "product_description": F.col("product_description"),
    }
    return facts.filter(_has_terms()).select(
        "product_uid", "category_id", "end_date", has_rows.alias("has_rows"), *more,
        *[F.coalesce(value.cast("string"), F.lit("None")).alias("v_" + name) for name, value in values.items()],
    )


def _visible(db: Tables) -> DataFrame:
    return attribute_values(db, visible_only=True).select("product_uid", "pcc_uid", "column_name", "value")


@dataclass
class _Parts:
    terms: DataFrame  # product_uid and what the clauses are filled with
    attribute_rows: DataFrame  # product_uid, clause_no, row_no, label, value, without strike dates
    rejects: DataFrame


def _parts(db: Tables, as_of: dt.date, instances: DataFrame | None, bank_name: str) -> _Parts:
    visible = _visible(db)
    with_rows = visible.select("product_uid").distinct().withColumn("_has_rows", F.lit(True))
    facts = contract_facts(db, instances).join(with_rows, "product_uid", "left")
    table_at = F.create_map(*[
        F.lit(x) for category, items in clauses.BY_CATEGORY.items() if clauses.TABLE in items
        for x in (category, items.index(clauses.TABLE))
    ])
    tables = facts.filter(_has_terms()).select(
        "product_uid", F.try_element_at(table_at, F.col("category_id")).cast("bigint").alias("clause_no")
    ).filter(F.col("clause_no").isNotNull())
    rows = tables.join(visible, "product_uid").select(
        "product_uid", "clause_no", F.col("pcc_uid").alias("row_no"), F.col("column_name").alias("label"), "value"
    )
    rejects = facts.filter(~_has_terms()).select("product_uid", F.lit("missing_terms").alias("reason"))
    return _Parts(_terms(facts, F.col("_has_rows").isNotNull(), as_of, bank_name), rows, rejects)


@dataclass
class ContractLines:
    lines: DataFrame  # product_uid, clause_no, row_no, kind, text, label, value
    rejects: DataFrame  # product_uid, reason


def contract_lines(
    db: Tables, as_of: dt.date, instances: DataFrame | None = None, bank_name: str = dims.BANK_NAME
) -> ContractLines:
    """Contracts as rows: a paragraph each, and one row for each row of the attribute table.

    Clauses are column expressions chosen by category, so paragraphs need no join with a template
    table. Kind ``none`` is a clause left out. Table rows stay rows, ordered by ``row_no``, so no
    contract is ever gathered in one task. Instances without the terms a contract states are
    rejected. A missing date reads ``None``.
    """
    parts = _parts(db, as_of, instances, bank_name)
    return ContractLines(_lines(parts), parts.rejects)


def _lines(parts: _Parts) -> DataFrame:
    none = F.lit(None).cast("string")
    # Exploded where it is built: as a column of its own the optimizer would copy it into filters.
    exploded = parts.terms.select(
        "product_uid", "category_id", "end_date", F.posexplode(F.expr(_clauses_sql())).alias("clause_no", "c")
    )
    # A DER table always ends with the strike date, so that row comes from the clause itself.
    is_table = F.col("c.kind") == "table"
    text_lines = exploded.filter(~is_table | (F.col("category_id") == "DER")).select(
        "product_uid", F.col("clause_no").cast("bigint").alias("clause_no"),
        F.when(is_table, F.lit(_LAST_ROW)).otherwise(F.lit(0)).cast("bigint").alias("row_no"),
        F.col("c.kind").alias("kind"), F.col("c.text").alias("text"),
        F.when(is_table, F.lit(clauses.STRIKE_DATE_LABEL)).alias("label"), F.when(is_table, F.col("end_date")).alias("value"),
    )
    table_lines = parts.attribute_rows.select(
        "product_uid", "clause_no", "row_no", F.lit("table").alias("kind"), none.alias("text"), "label", "value"
    )
    return text_lines.unionByName(table_lines)


# --- documents ---------------------------------------------------------------------------------


def contract_documents(
    db: Tables, as_of: dt.date, instances: DataFrame | None = None, bank_name: str = dims.BANK_NAME, page_size: int | None = None
) -> DataFrame:
    """Contracts as documents: (product_uid, part_no, contents array of elements).

    Paragraphs never leave the row of their contract; only table rows are gathered, before they meet
    it, so that the facts of a contract are put together once. A contract is one
    document. With ``page_size``, a contract whose table has more rows than that is put together from
    lines instead, and long tables go on in further table elements and further parts.
    """
    if page_size is not None:
        lines = contract_lines(db, as_of, instances, bank_name).lines
        if has_large_group(lines.filter(F.col("kind") == "table"), ["product_uid"], page_size):
            return documents_from_lines(lines, page_size)
    visible = _visible(db)
    if instances is not None:
        visible = visible.join(instances, "product_uid", "left_semi")
    row = F.struct("pcc_uid", F.array("column_name", "value").alias("row"))
    tables = visible.groupBy("product_uid").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    facts = contract_facts(db, instances).join(tables, "product_uid", "left")
    terms = _terms(facts, F.col("rows").isNotNull(), as_of, bank_name, "rows")
    none = F.array().cast("array<array<string>>")
    strike = F.array(F.array(F.lit(clauses.STRIKE_DATE_LABEL), F.col("end_date")))
    data = F.concat(
        F.coalesce(F.transform("rows", lambda r: r["row"]), none), F.when(F.col("category_id") == "DER", strike).otherwise(none)
    )
    contents = F.transform(
        F.expr(_clauses_sql()),
        lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text"), F.when(e["kind"] == "table", data).alias("data")),
    )
    return terms.select("product_uid", F.lit(0).cast("bigint").alias("part_no"), contents.alias("contents"))


def documents_from_lines(lines: DataFrame, page_size: int) -> DataFrame:
    """Documents put together from lines, in parts of at most ``page_size`` elements."""
    table_rows = lines.filter(F.col("kind") == "table")
    rows, keys = paged(table_rows, ["product_uid", "clause_no"], ["row_no"], page_size)
    row = F.struct("row_no", F.array("label", "value").alias("row"))
    tables = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "product_uid", "clause_no", "page_no", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"),
        F.transform("rows", lambda r: r["row"]).alias("data"),
    )
    texts = lines.filter(F.col("kind") != "table").select(
        "product_uid", "clause_no", F.lit(0).cast("bigint").alias("page_no"), "kind", "text",
        F.lit(None).cast("array<array<string>>").alias("data"),
    )
    elements = texts.unionByName(tables).withColumnRenamed("page_no", "table_page")
    elements, keys = paged(elements, ["product_uid"], ["clause_no", "table_page"], page_size)
    element = F.struct("clause_no", "table_page", F.struct("kind", "text", "data").alias("element"))
    return elements.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias("e")).select(
        "product_uid", F.col("page_no").alias("part_no"), F.transform("e", lambda e: e["element"]).alias("contents")
    )


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def contract_to_json(contents: Column) -> Column:
    """Document as JSON: paragraphs are strings, a table an object with rows, a left-out clause null."""
    items = F.transform(
        contents,
        lambda e: F.when(e["kind"] == "text", _json_string(e["text"]))
        .when(e["kind"] == "table", F.concat(F.lit('{"type":"table","data":'), F.to_json(e["data"]), F.lit("}")))
        .otherwise("null"),
    )
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def contract_from_json(text: Column) -> Column:
    """Document from JSON, as an array of elements."""
    def element(raw: Column) -> Column:
        table = F.from_json(raw, "type STRING, data ARRAY<ARRAY<STRING>>")
        is_table = raw.startswith('{"type":"table"') | raw.startswith('{"type": "table"')
        return F.struct(
            F.when(raw.isNull(), "none").when(is_table, "table").otherwise("text").alias("kind"),
            F.when(~is_table, raw).alias("text"),
            F.when(is_table, table["data"]).alias("data"),
        )

    return F.transform(F.from_json(text, "array<string>"), element)


def render_contracts(
    db: Tables, as_of: dt.date, instances: DataFrame | None = None, bank_name: str = dims.BANK_NAME
) -> DataFrame:
    """Unsigned contracts as JSON, ``(product_uid, part_no, unsigned_contract)``."""
    documents = contract_documents(db, as_of, instances, bank_name)
    return documents.select("product_uid", "part_no", contract_to_json(F.col("contents")).alias("unsigned_contract"))


def store_contracts(db: Tables, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New contract rows with keys, and all instances with the key of their new contract.

    An instance has one contract: parts of a document are put together again, in order.
    """
    text = F.substr("unsigned_contract", F.lit(2), F.length("unsigned_contract") - 2)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part_no", text.alias("text")))), lambda p: p["text"])
    whole = rendered.groupBy("product_uid").agg(
        F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("unsigned_contract"))
    # Keys are given to the instances alone: whole texts are neither sorted nor kept for it.
    keys = append_with_ids(db.contracts, whole.select("product_uid"), "contract_id", ["product_uid"])
    contracts = whole.join(keys, "product_uid")
    first = keys.select("product_uid", F.col("contract_id").alias("_new_contract"))
    instances = db.product_instances.join(first, "product_uid", "left").select(*[
        F.coalesce("_new_contract", "contract_id").alias(c) if c == "contract_id" else F.col(c)
        for c in db.product_instances.columns
    ])
    return (
        contracts.select("contract_id", "unsigned_contract", F.lit(None).cast("string").alias("signed_contract")),
        instances,
    )


def effective_contract(contracts: DataFrame) -> DataFrame:
    """The signed text if there is one, else the unsigned."""
    return contracts.select("contract_id", C.nvl(F.col("signed_contract"), F.col("unsigned_contract")).alias("contract"))


def sign_contents(contents: Column, first_name: Column, last_name: Column, as_of: dt.date) -> Column:
    """The document with its last two elements replaced by signature and date."""
    values = {"first_name": first_name, "last_name": last_name, "now": _now_text(as_of)}

    def paragraph(template: str) -> Column:
        return F.struct(
            F.lit("text").alias("kind"), _fill(template, values).alias("text"),
            F.lit(None).cast("array<array<string>>").alias("data"),
        )

    kept = F.slice(contents, F.lit(1), F.greatest(F.size(contents) - 2, F.lit(0)))
    return F.concat(kept, F.array(paragraph(clauses.SIGNATURE), paragraph(clauses.SIGNATURE_DATE)))


@dataclass
class Signed:
    instances: DataFrame  # all instances afterwards
    contracts: DataFrame | None  # all contracts afterwards, if the bank keeps them
    audit: DataFrame
    rejects: DataFrame  # request_id, product_uid, reason


def sign_contracts(db: Tables, requests: DataFrame, as_of: dt.datetime) -> Signed:
    """Sign contracts for ``requests(request_id, product_uid, account_id)``.

    Only the owner may sign, while the product is sent for signing and the account verified. The
    first good request moves the product on to AWT; later ones find it already signed.
    """
    rows = db.product_instances.select(
        "product_uid", F.col("account_id").alias("owner_id"), "status_code", "contract_id",
        F.lit(True).alias("_known"),
    )
    people = db.accounts.select("account_id", "first_name", "last_name", "verification")
    checked = requests.join(rows, "product_uid", "left").join(people, "account_id", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "unknown_instance")
        .when(~F.col("owner_id").eqNullSafe(F.col("account_id")), "not_the_owner")
        .when(F.col("status_code") != "SGN", "status_not_for_signing")
        .when(~F.col("verification").eqNullSafe("Y"), "account_not_verified"),
    )
    good = checked.filter(F.col("reason").isNull())
    first = good.groupBy("product_uid").agg(
        F.min(F.struct("request_id", "account_id", "first_name", "last_name", "contract_id")).alias("_sign")
    )
    late = good.join(first, "product_uid").filter(F.col("request_id") != F.col("_sign.request_id"))
    signed = F.col("_sign").isNotNull()
    new_values = {
        "status_code": F.when(signed, "AWT").otherwise(F.col("status_code")),
        "latest_update_user_id": F.coalesce("_sign.account_id", "latest_update_user_id"),
    }
    instances = db.product_instances.join(first, "product_uid", "left").select(*[
        new_values[c].alias(c) if c in new_values else F.col(c) for c in db.product_instances.columns
    ])
    contracts = getattr(db, "contracts", None)
    if contracts is not None:
        by_contract = first.select(F.col("_sign.contract_id").alias("contract_id"), "_sign")
        contents = contract_from_json(F.col("unsigned_contract"))
        text = contract_to_json(
            sign_contents(contents, F.col("_sign.first_name"), F.col("_sign.last_name"), as_of)
        )
        contracts = contracts.join(by_contract, "contract_id", "left").select(
            "contract_id", "unsigned_contract", F.when(signed, text).otherwise(F.col("signed_contract")).alias("signed_contract")
        )
    audit = first.select(
        "product_uid", F.lit("SGN").alias("was_status"), F.lit("AWT").alias("is_code"),
        C.moment(as_of).alias("update_dt"), F.col("_sign.account_id").alias("update_user"),
        F.lit(None).cast("string").alias("update_note"), F.lit(None).cast("string").alias("update_note_public_yn"),
    )
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "product_uid", "reason").unionByName(
        late.select("request_id", "product_uid", F.lit("status_not_for_signing").alias("reason"))
    )
    return Signed(instances, contracts, audit, rejects)
