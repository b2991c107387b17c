import re

from bankspark.operators import accounts
from bankspark.sources.tables import Tables
from tests.conftest import table

PEOPLE = [
    # id, first, last, email, phone, country, group, verification, role
    (1, "Automated", "Action", None, None, "BGR", "EMP", "Y", "A"),
    (2, "Ann", "Lee", "ann.lee@bank.test", "+359111222", "BGR", "FTC", "N", "U"),
    (3, "Lee", "Ann", "LEE@bank.test", "+359222333", "USA", "RTC", "Y", "U"),
    (4, "Lee", "Lee", None, "+1444", "OTH", "FTC", "C", "E"),
    (5, "Bob", "Ann", "b_o.b@my-bank.test", "12", None, "LTP", "R", "U"),
    (6, None, "Ann", "x@bank.test", "+3591112", "USA", "FTC", "Y", "C"),
]


def bank(spark, frame):
    keys = ["account_id", "first_name", "last_name", "email", "phone", "country_code", "account_group", "verification", "user_role"]
    return Tables(spark, accounts=table(frame, "accounts", [dict(zip(keys, p)) for p in PEOPLE]))


def by_hand(text):
    """Rules one word at a time."""
    names, email, group, country, phone = [], None, None, None, None
    for word in text.split():
        if re.match(r"^[a-zA-Z0-9]+$", word):
            names.append(word.lower())
        elif re.match(r"^[\w\.]+@([\w-]+\.)+[\w-]{2,4}$", word):
            email = word.lower()
        elif re.match(r"^group:[A-Z]{1,3}$", word):
            group = word[6:]
        elif re.match(r"^country_code:[A-Z]{1,3}$", word):
            country = word[13:]
        elif re.match(r"^phone:[+0-9]{4,15}$", word):
            phone = word[6:]
    found = set()
    for aid, first, last, mail, number, land, code, *_ in PEOPLE:
        first_in, last_in = (first or "").lower() in names, (last or "").lower() in names
        checks = []
        if names:
            checks.append(first_in or last_in if len(names) == 1 else first_in and last_in)
        if email:
            checks.append((mail or "").lower() == email)
        if group:
            checks.append(code == group)
        if country:
            checks.append(land == country)
        if phone:
            checks.append(phone in (number or ""))
        if all(checks) if checks else aid != 1:
            found.add(aid)
    return found


def test_search(spark, frame):
    texts = [
        "lee", "LEE ann", "lee lee", "ann bob", "zed", "ann.lee@bank.test", "lee@BANK.test ann", "group:FTC", "group:ftc",
        "country_code:USA", "country:USA", "phone:1112", "phone:+359", "phone:111", "", "   ", "O'Neil", "Ünal", "group:FTC group:RTC",
        "  lee   group:FTC ", "phone:+359 country_code:BGR", "b_o.b@my-bank.test", "ann@bank.example", "country_code:USA group:RTC phone:2333",
        "lee\tann", "automated", "ann phone:1112", "phone:9111222", "phone:+359111222", "a b c d e f g h i lee ann", "lee lee lee",
    ]
    requests = frame("request_id BIGINT, search_str STRING", list(enumerate(texts)))
    rows = accounts.search_accounts(bank(spark, frame), requests).collect()
    for i, text in enumerate(texts):
        got = [r.account_id for r in rows if r.request_id == i]
        assert len(got) == len(set(got)), text
        assert set(got) == by_hand(text), text


def test_filters_combine(spark, frame):
    db = bank(spark, frame)
    ids = lambda df: sorted(r.account_id for r in df.collect())
    assert ids(accounts.accounts(db)) == [1, 2, 3, 4, 5, 6]
    assert ids(accounts.accounts(db, country=["USA", "BGR"], role=["U"])) == [2, 3]
    assert ids(accounts.accounts(db, country=[])) == [1, 2, 3, 4, 5, 6]
    assert ids(accounts.unverified_accounts(db)) == [2, 4]
    assert ids(accounts.staff_accounts(db)) == [1, 4, 6]


def test_missing_code_drops_the_account(spark, frame):
    db = Tables(spark, accounts=table(frame, "accounts", [{"account_id": 1, "user_role": "U", "verification": "Y"}]))
    assert accounts.account_profile(db).isEmpty()


def test_role_group_and_verification_changes(spark, frame):
    db = bank(spark, frame)
    roles = frame("request_id BIGINT, account_id BIGINT, new_role STRING", [(1, 2, "E"), (2, 2, "X"), (3, 4, "U"), (4, 99, "U")])
    done = accounts.change_roles(db, roles)
    assert {(r.account_id, r.user_role, r.account_group) for r in done.changed.collect()} == {(2, "E", "EMP"), (4, "U", "FTC")}
    assert {(r.request_id, r.reason) for r in done.rejects.collect()} == {(2, "unknown_role"), (4, "unknown_account")}
    assert done.accounts.count() == 6
    groups = frame("request_id BIGINT, account_id BIGINT, new_group STRING", [(1, 2, "LTP"), (2, 2, "RTC"), (3, 3, "???")])
    done = accounts.change_groups(db, groups)
    assert {(r.account_id, r.account_group) for r in done.changed.collect()} == {(2, "RTC")}
    codes = frame(
        "request_id BIGINT, account_id BIGINT, new_code STRING, user_id BIGINT, user_role STRING",
        [(1, 2, "C", 2, "U"), (2, 3, "Y", 3, "U"), (3, 3, "C", 2, "U"), (4, 5, "Y", 4, "E"), (5, 6, "?", 4, "E")],
    )
    done = accounts.change_verification(db, codes)
    assert {(r.account_id, r.verification) for r in done.changed.collect()} == {(2, "C"), (5, "Y")}
    assert {(r.request_id, r.reason) for r in done.rejects.collect()} == {
        (2, "not_allowed"), (3, "not_allowed"), (5, "unknown_verification")
    }


def test_latest_account_by_name(frame):
    rows = frame("account_id BIGINT, first_name STRING, last_name STRING", [(1, "a", "b"), (7, "a", "b"), (3, "a", "c")])
    got = {(r.first_name, r.last_name): r.account_id for r in accounts.latest_account_by_name(rows).collect()}
    assert got == {("a", "b"): 7, ("a", "c"): 3}


def test_seven_digits_are_an_account_id(spark, frame):
    db = Tables(spark, accounts=table(frame, "accounts", [
        {"account_id": 2000005, "first_name": "Ann", "last_name": "Lee", "account_group": "FTC", "verification": "Y"},
        {"account_id": 7, "first_name": "2000005", "last_name": "Lee", "account_group": "FTC", "verification": "Y"},
    ]))
    asked = frame("request_id BIGINT, search_str STRING", [(1, " 2000005 "), (2, "0000007"), (3, "2000005 Lee"), (4, "200000")])
    got = {(r.request_id, r.account_id) for r in accounts.search_accounts(db, asked).collect()}
    assert got == {(1, 2000005), (2, 7), (3, 7)}


def found(rows):
    return sorted((r.request_id, r.account_id) for r in rows.collect())


SEARCHES = ["lee", "LEE ann", "ann bob", "group:FTC", "country_code:USA", "phone:1112", "phone:9111222", "", "x@bank.test", "lee group:FTC", "  "]


def test_stored_index_finds_the_same(spark, frame, tmp_path, monkeypatch):
    from bankspark.operators import search_index as S

    monkeypatch.setattr(S, "POSTINGS", 2)
    db, requests = bank(spark, frame), frame("request_id BIGINT, search_str STRING", list(enumerate(SEARCHES)))
    index = S.SearchIndex(spark, f"{tmp_path}/index", buckets=4)
    index.build(db.accounts)
    parts = accounts.search_in_parts(db, requests, index.search)
    open_ = sorted(r.request_id for r in parts.unrestricted.collect())
    assert open_ == [7, 10] and sorted(r.account_id for r in parts.everyone.collect()) == [2, 3, 4, 5, 6]
    whole = [x for x in found(accounts.search_accounts(db, requests)) if x[0] not in open_]
    assert found(parts.found) == whole
    plain = accounts.search_in_parts(db, requests)
    assert found(plain.found) == whole


def test_index_follows_changes(spark, frame, tmp_path):
    from bankspark.operators import search_index as S

    db, requests = bank(spark, frame), frame("request_id BIGINT, search_str STRING", list(enumerate(SEARCHES)))
    index = S.SearchIndex(spark, f"{tmp_path}/index", buckets=4)
    index.build(db.accounts)
    schema = db.accounts.schema
    now = db.accounts
    changes = [
        [{"account_id": 2, "first_name": "Anna", "phone": "+359111299"}, {"account_id": 4, "account_group": "RTC"}],
        [{"account_id": 2, "first_name": "Ann"}, {"account_id": 5, "last_name": "Lee", "email": None}],
    ]
    for version, changed in enumerate(changes):
        old = {r.account_id: r.asDict() for r in now.collect()}
        new = {**old, **{c["account_id"]: {**old[c["account_id"]], **c} for c in changed}}
        frame_of = lambda rows: spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema)
        ids = [c["account_id"] for c in changed]
        for _ in range(2):  # a version that is written again is the same
            index.update(version, frame_of([old[i] for i in ids]), frame_of([new[i] for i in ids]))
        now = frame_of(new.values())
        some = requests.filter("trim(search_str) <> ''")
        assert found(index.search(db.replace(accounts=now), some)) == found(accounts.search_accounts(db.replace(accounts=now), some))


def test_index_reads_only_buckets_that_are_asked_for(spark, frame, tmp_path):
    from bankspark.operators import search_index as S

    db = bank(spark, frame)
    index = S.SearchIndex(spark, f"{tmp_path}/index", buckets=64)
    index.build(db.accounts)
    asked = frame("request_id BIGINT, search_str STRING", [(1, "bob"), (2, "phone:1112")])
    wanted = accounts.lookups(accounts.parse_search(asked)).select("kind", "value", index.store.bucket())
    used = {r.bucket for r in wanted.collect()}
    broken = 0
    for path in (tmp_path / "index").glob("first=*/size=*/bucket=*/*.parquet"):
        if int(path.parent.name.split("=")[1]) not in used:
            path.write_bytes(b"broken")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken > 20 and len(used) <= 3
    assert found(index.search(db, asked)) == [(1, 5), (2, 2), (2, 6)]
