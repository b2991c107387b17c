"""Accounts: lists, profiles, search and role, group and verification changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bankspark.functions import columns as C
from bankspark.operators.ordering import append_with_ids
from bankspark.sources import dims
from bankspark.sources.tables import Tables

PROFILE_COLUMNS = [
    "account_id", "first_name", "last_name", "email", "phone", "country_code", "country", "address",
    "user_role_code", "user_role", "verification_code", "verification", "verification_emoji",
    "account_group_code", "account_group", "account_group_description", "created_dt",
]


def account_profile(db: Tables) -> DataFrame:
    """Accounts with role, verification and group spelled out; a missing code drops the account."""
    return _profiles(db.accounts, db)


def _profiles(accounts: DataFrame, db: Tables) -> DataFrame:
    roles = db.user_roles.select(F.col("role").alias("user_role"), F.col("description").alias("role_text"))
    checks = db.verifications.select(
        F.col("verification_status").alias("verification"), F.col("description").alias("verification_text")
    )
    groups = db.account_groups.select(F.col("group_code").alias("account_group"), "group_name", "group_description")
    return (
        accounts.join(roles, "user_role").join(checks, "verification").join(groups, "account_group")
        .select(
            "account_id", "first_name", "last_name", "email", "phone", "country_code",
            C.country_label(F.col("country_code")).alias("country"),
            "address",
            F.col("user_role").alias("user_role_code"), F.col("role_text").alias("user_role"),
            F.col("verification").alias("verification_code"), F.col("verification_text").alias("verification"),
            C.verification_badge(F.col("verification")).alias("verification_emoji"),
            F.col("account_group").alias("account_group_code"), F.col("group_name").alias("account_group"),
            F.col("group_description").alias("account_group_description"),
            "created_dt",
        )
    )


def accounts(
    db: Tables,
    country: list[str] | None = None,
    role: list[str] | None = None,
    verification: list[str] | None = None,
    group: list[str] | None = None,
) -> DataFrame:
    """Account list; values inside one list are alternatives, the lists combine with AND."""
    wanted = {"country_code": country, "user_role": role, "verification": verification, "account_group": group}
    conditions = [F.col(name).isin(values) for name, values in wanted.items() if values]
    return _profiles(db.accounts.filter(C.all_of(*conditions)), db)


def unverified_accounts(db: Tables) -> DataFrame:
    return accounts(db, verification=["N", "C"])


def staff_accounts(db: Tables) -> DataFrame:
    return accounts(db, role=list(dims.STAFF_ROLES))


def latest_account_by_name(rows: DataFrame) -> DataFrame:
    """Highest account id for each first and last name."""
    return rows.groupBy("first_name", "last_name").agg(F.max("account_id").alias("account_id"))


# --- search ------------------------------------------------------------------------------------

# What a search word may be; the first pattern that matches decides.
WORD_PATTERNS = {
    "name": r"^[a-zA-Z0-9]+$",
    "email": r"^[\w.]+@([\w-]+\.)+[\w-]{2,4}$",
    "group": r"^group:[A-Z]{1,3}$",
    "country_code": r"^country_code:[A-Z]{1,3}$",
    "phone": r"^phone:[+0-9]{4,15}$",
}
_PHONE_PIECES = (7, 4)  # lengths of indexed phone pieces; 4 is the shortest part a search accepts
_PAIR_WORDS = 8  # up to this many names, first and last name are looked up together
_SALTS = 32


def parse_search(requests: DataFrame) -> DataFrame:
    """Search texts as criteria: lower-case names, and the last e-mail, group, country and phone.

    A text of seven digits alone is an account id.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace("search_str", r"(?U)\s+", " ")), " "), lambda w: w != "")
    # (?U): letters of any script count as word characters.
    patterns = ["(?U)" + p for p in WORD_PATTERNS.values()]

    def words_of(place: int):
        return F.filter(
            "_words", lambda w: C.all_of(w.rlike(patterns[place]), *[~w.rlike(p) for p in patterns[:place]])
        )

    found = {kind: words_of(place) for place, kind in enumerate(WORD_PATTERNS)}

    def last(kind):
        return F.try_element_at(found[kind], F.lit(-1))

    def after_colon(kind):
        return F.split_part(last(kind), F.lit(":"), F.lit(2))

    id_only = F.trim("search_str").rlike("^[0-9]{7}$")
    return requests.select("request_id", "search_str", words.alias("_words")).select(
        "request_id",
        "search_str",
        F.when(id_only, F.trim("search_str").cast("bigint")).alias("id_key"),
        F.when(id_only, F.array().cast("array<string>")).otherwise(F.transform(found["name"], F.lower)).alias("names"),
        F.lower(last("email")).alias("email_key"),
        F.upper(after_colon("group")).alias("group_key"),
        F.upper(after_colon("country_code")).alias("country_key"),
        after_colon("phone").alias("phone_part"),
    )


def _entry(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _pair(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def lookups(parsed: DataFrame) -> DataFrame:
    """Parsed searches with the ``kind`` and ``value`` to look accounts up by, a row for each.

    That is the most selective criterion of a search; kind ``all`` if it has none. Several names are looked up as
    pairs of first and last name, a phone part by its last characters, which are rarer than a country prefix.
    """
    names = F.array_distinct("names")
    pairs = F.flatten(F.transform(names, lambda a: F.transform(names, lambda b: _entry("full", _pair(a, b)))))
    long_piece, short_piece = _PHONE_PIECES
    phone_entry = F.when(
        F.length("phone_part") >= long_piece, _entry(f"phone{long_piece}", F.right("phone_part", F.lit(long_piece)))
    ).otherwise(_entry(f"phone{short_piece}", F.right("phone_part", F.lit(short_piece))))
    lookup = (
        F.when(F.col("id_key").isNotNull(), F.array(_entry("id", F.col("id_key").cast("string"))))
        .when(F.col("email_key").isNotNull(), F.array(_entry("email", F.col("email_key"))))
        .when((F.size("names") > 1) & (F.size(names) <= _PAIR_WORDS), pairs)
        .when(F.size("names") > 1, F.transform(names, lambda n: _entry("last", n)))
        .when(F.col("phone_part").isNotNull(), F.array(phone_entry))
        .when(
            F.size("names") == 1,
            F.array(_entry("first", F.col("names")[0]), _entry("last", F.col("names")[0])),
        )
        .when(F.col("group_key").isNotNull(), F.array(_entry("group", F.col("group_key"))))
        .when(F.col("country_key").isNotNull(), F.array(_entry("country", F.col("country_key"))))
        .otherwise(F.array(_entry("all", F.lit(""))))
    )
    return (
        parsed.withColumn("_lookup", F.explode(lookup))
        .withColumn("kind", F.col("_lookup.kind")).withColumn("value", F.col("_lookup.value")).drop("_lookup")
    )


def entries(accounts: DataFrame) -> DataFrame:
    """``(account_id, kind, value)`` of everything an account can be looked up by, and ``all``."""
    def phone_pieces(size):
        starts = F.sequence(F.lit(1), F.length("phone") - size + 1)
        pieces = F.transform(starts, lambda i: _entry(f"phone{size}", F.substr(F.col("phone"), i, F.lit(size))))
        return F.when(F.length("phone") >= size, F.array_distinct(pieces)).otherwise(F.array())

    of_account = F.concat(
        F.array(
            _entry("id", F.col("account_id").cast("string")),
            _entry("email", F.lower("email")),
            _entry("first", F.lower("first_name")),
            _entry("last", F.lower("last_name")),
            _entry("full", _pair(F.lower("first_name"), F.lower("last_name"))),
            _entry("group", F.upper("account_group")),
            _entry("country", F.upper("country_code")),
            _entry("all", F.lit("")),
        ),
        *[phone_pieces(size) for size in _PHONE_PIECES],
    )
    return accounts.select("account_id", F.explode(of_account).alias("_entry")).select("account_id", "_entry.kind", "_entry.value")


def _shown(db: Tables, rows: DataFrame, *first: str) -> DataFrame:
    """Accounts as a search shows them, after the columns ``first``."""
    groups = db.account_groups.select(F.col("group_code").alias("account_group"), "group_name")
    return rows.join(groups, "account_group").select(
        *first, "account_id", "first_name", "last_name", "email", "phone",
        F.col("verification").alias("verification_code"),
        C.verification_badge(F.col("verification")).alias("verification_emoji"),
        F.col("account_group").alias("account_group_code"), F.col("group_name").alias("account_group_name"),
    )


_PEOPLE = ["account_id", "first_name", "last_name", "email", "phone", "country_code", "verification", "account_group"]
_CRITERIA = ("id_key", "email_key", "group_key", "country_key", "phone_part")


def without_criterion() -> Column:
    """Whether a parsed search has nothing to look for."""
    return C.all_of(F.size("names") == 0, *[F.col(c).isNull() for c in _CRITERIA])


def looked_up(db: Tables, candidates: DataFrame) -> DataFrame:
    """What the other criteria leave of ``candidates``: parsed searches with an account_id each that a look-up gave."""
    first_in, last_in = F.array_contains("names", F.lower("first_name")), F.array_contains("names", F.lower("last_name"))
    names_ok = F.when(F.size("names") == 0, True).when(F.size("names") == 1, first_in | last_in).otherwise(first_in & last_in)

    def ok(criterion, test):
        return F.col(criterion).isNull() | test

    matches = C.all_of(
        names_ok,
        ok("id_key", F.col("account_id") == F.col("id_key")),
        ok("email_key", F.lower("email") == F.col("email_key")),
        ok("group_key", F.upper("account_group") == F.col("group_key")),
        ok("country_key", F.upper("country_code") == F.col("country_key")),
        ok("phone_part", F.contains("phone", "phone_part")),
        ~without_criterion() | (F.col("account_id") != dims.AUTOMATION_ACCOUNT),
    )
    # An account found by its first and by its last name is kept once.
    found_twice = (F.col("kind") == "last") & (F.size("names") == 1) & F.coalesce(
        F.lower("first_name") == F.col("value"), F.lit(False)
    )
    people = db.accounts.select(*_PEOPLE)
    return _shown(db, candidates.join(people, "account_id").filter(matches & ~found_twice), "request_id")


def search_accounts(db: Tables, requests: DataFrame) -> DataFrame:
    """Accounts found for each search text of ``requests(request_id, search_str)``.

    Seven digits alone are an account id. One name matches the first or the last name; several must hold both. E-mail, group and country
    compare whole and without case, a phone part may stand anywhere. A text without any criterion
    lists every account but the automation one. Names with other than ASCII letters and digits are
    ignored, and a country is written ``country_code:``.

    Each request looks accounts up by its most selective criterion with an equi-join, and the others
    filter what was found. A phone part is looked up among all pieces of that length of the phone numbers, so
    none is missed. Look-up values are salted, since one name, group or country may hold a third of all accounts.
    ``search_index`` keeps the look-up side stored, for few searches over many accounts.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    wanted = lookups(parse_search(requests)).withColumn("salt", salts)
    # Keys only: an account has some twenty entries, so its data joins after the look-up.
    index = entries(db.accounts).withColumn("salt", F.pmod(F.xxhash64("account_id"), F.lit(_SALTS)).cast("int"))
    return looked_up(db, wanted.join(index, ["kind", "value", "salt"]))


@dataclass
class Searched:
    """Results of searches in parts, so that a search without a criterion costs one row."""

    found: DataFrame  # request_id and account, for the searches with a criterion
    unrestricted: DataFrame  # request_id of the searches without one
    everyone: DataFrame  # what each of those lists


def search_in_parts(db: Tables, requests: DataFrame, find=None) -> Searched:
    """The rows of ``search_accounts``: ``found``, and each of ``unrestricted`` with each of ``everyone``.

    ``find`` is the search for those with a criterion, ``search_accounts`` if not given.
    """
    open_ = without_criterion()
    parsed = parse_search(requests)
    some = parsed.filter(~open_).select("request_id", "search_str")
    people = db.accounts.filter(F.col("account_id") != dims.AUTOMATION_ACCOUNT).select(*_PEOPLE)
    return Searched(
        (find or search_accounts)(db, some), parsed.filter(open_).select("request_id"), _shown(db, people)
    )


# --- changes -----------------------------------------------------------------------------------


@dataclass
class AccountChanges:
    accounts: DataFrame  # all accounts after the change
    changed: DataFrame  # the accounts that took a change
    rejects: DataFrame  # request_id, account_id, reason


def _last_code(requests: DataFrame, known_codes: DataFrame, code_column: str, known_accounts: DataFrame, reason: str):
    """Last valid code asked for each account, and the requests refused.

    Requests are reduced to one per account before they meet the accounts.
    """
    codes = known_codes.select(F.col(known_codes.columns[0]).alias(code_column))
    valid = (
        requests.join(codes, code_column, "left_semi")
        .groupBy("account_id").agg(F.max_by(code_column, "request_id").alias(code_column))
    )
    ids = known_accounts.select("account_id", F.lit(True).alias("_known_account"))
    why = F.when(F.col("_known_account").isNull(), "unknown_account").when(F.col("_known_code").isNull(), reason)
    checked = (
        requests.join(codes.withColumn("_known_code", F.lit(True)), code_column, "left")
        .join(ids, "account_id", "left").withColumn("reason", why)
    )
    return valid, checked.filter(F.col("reason").isNotNull()).select("request_id", "account_id", "reason")


def _apply(db: Tables, valid: DataFrame, rejects: DataFrame, new_columns: dict) -> AccountChanges:
    columns = db.accounts.columns
    after = [
        F.when(F.col("_asked").isNotNull(), new_columns[c]).otherwise(F.col(c)).alias(c) if c in new_columns else F.col(c)
        for c in columns
    ]
    joined = db.accounts.join(valid, "account_id", "left")
    return AccountChanges(
        joined.select(*after), joined.filter(F.col("_asked").isNotNull()).select(*after), rejects
    )


def change_roles(db: Tables, requests: DataFrame) -> AccountChanges:
    """Set roles from ``requests(request_id, account_id, new_role)``; staff move to group EMP, others to FTC."""
    valid, rejects = _last_code(requests, db.user_roles.select("role"), "new_role", db.accounts, "unknown_role")
    role = F.col("_asked")
    group = F.when(role.isin(*dims.STAFF_ROLES), "EMP").otherwise("FTC")
    return _apply(
        db, valid.withColumnRenamed("new_role", "_asked"), rejects, {"user_role": role, "account_group": group}
    )


def change_groups(db: Tables, requests: DataFrame) -> AccountChanges:
    """Set account groups from ``requests(request_id, account_id, new_group)``."""
    valid, rejects = _last_code(requests, db.account_groups.select("group_code"), "new_group", db.accounts, "unknown_group")
    return _apply(db, valid.withColumnRenamed("new_group", "_asked"), rejects, {"account_group": F.col("_asked")})


def change_verification(db: Tables, requests: DataFrame) -> AccountChanges:
    """Set verification codes from ``requests(request_id, account_id, new_code, user_id, user_role)``.

    A client may only ask for code C, and only for the own account.
    """
    allowed = C.is_staff(F.col("user_role")) | F.coalesce(
        (F.col("new_code") == "C") & (F.col("user_id") == F.col("account_id")), F.lit(False)
    )
    refused = requests.filter(~allowed).select("request_id", "account_id", F.lit("not_allowed").alias("reason"))
    asked = requests.filter(allowed).select("request_id", "account_id", "new_code")
    valid, rejects = _last_code(
        asked, db.verifications.select("verification_status"), "new_code", db.accounts, "unknown_verification"
    )
    return _apply(
        db, valid.withColumnRenamed("new_code", "_asked"), rejects.unionByName(refused), {"verification": F.col("_asked")}
    )


def create_accounts(db: Tables, signups: DataFrame, as_of) -> DataFrame:
    """New client accounts for ``signups(request_id, first_name, last_name, email, phone, country, address)``."""
    rows = signups.select(
        "request_id", "first_name", "last_name", "email", "phone", F.col("country").alias("country_code"), "address",
        F.lit("U").alias("user_role"), F.lit("N").alias("verification"), F.lit("FTC").alias("account_group"),
        C.moment(as_of).alias("created_dt"),
    )
    return append_with_ids(db.accounts, rows, "account_id", ["request_id"], base=dims.ACCOUNT_ID_BASE)
