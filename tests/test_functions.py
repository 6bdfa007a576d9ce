"""Golden cases of the column functions."""

from decimal import Decimal

from pyspark.sql import functions as F

from deskloom.functions import legacy as L
from deskloom.functions import payload as J
from deskloom.functions import people as P
from deskloom.functions import status as S
from deskloom.functions import text as T
from deskloom.functions import tickets as K

STATUSES = [None, "", "on hold", "COMPLETE", "completed", "In Progress", "in_progress", " completed"]


def test_status(values):
    pending, ongoing, complete = "Pending", "Ongoing", "Complete"
    assert values(S.status_label, STATUSES) == [pending] * 3 + [complete] * 2 + [ongoing] * 2 + [pending]
    assert values(S.status_store, STATUSES) == [
        *["pending"] * 3, "completed", "completed", "in progress", "in_progress", "completed",
    ]
    assert values(S.status_store_workbook, [None, "Weird", "Complete", " complete"]) == [
        "pending", "weird", "completed", " complete",
    ]


def test_date_completed_is_case_sensitive(values):
    got = values(lambda c: S.date_completed(c, F.lit("d")), ["completed", "complete", "Complete", None])
    assert got == ["d", "d", None, None]


def test_status_transition(spark):
    df = spark.createDataFrame([("pending", "completed"), ("x", "pending"), ("IN PROGRESS", "")], "a string, b string")
    got = [r[0] for r in df.select(S.status_transition(F.col("a"), F.col("b"))).collect()]
    assert got == ["from Pending to Completed", None, "from Ongoing to Pending"]


def test_is_active(values):
    assert values(P.is_active, [None, "0", "1", " YES ", "on", "True"]) == [False, False, True, True, False, True]
    assert values(lambda c: P.is_active(c, "int"), [None, 0, 1, 2], "int") == [False, False, True, True]


def test_job_orders(values):
    got = values(K.jo_number, ["jo-0012", "JO-7", "jo-1000", "draft", "jo-", None, "jo-12x", "jo-9999999"])
    assert got == [12, 7, 1000, None, None, None, None, 9999999]
    assert values(K.jo_format, [1, 13, 9999, 10000], "bigint") == ["jo-0001", "jo-0013", "jo-9999", "jo-10000"]


def test_legacy_block(values):
    block = "Contact: 09\nREPORTED CONCERN: a: b\n  Assigned to:  Bob \nassigned to: Eve"
    texts = [block, "IT Support", "", None, "contact: 1", "Assigned to:\nx"]
    assert values(L.legacy_concern, texts) == ["a: b", None, None, None, None, None]
    assert values(L.assigned_to, texts) == ["Bob", "IT Support", None, None, "contact: 1", "Assigned to:\nx"]
    assert values(L.legacy_contact, texts) == ["09", None, None, None, None, None]


def test_pack_legacy(spark):
    df = spark.createDataFrame([("09", "broken", None, "a@b.c"), ("", "x", "Bob", None)], "c string, r string, a string, e string")
    c, r, a, e = (F.col(n) for n in "crae")
    packed = [row[0] for row in df.select(L.pack_legacy(c, r, a, e)).collect()]
    assert packed == ["Email: a@b.c\nContact: 09\nReported concern: broken", "Reported concern: x\nAssigned to: Bob"]
    assert df.select(L.pack_legacy(c, r, a)).first()[0] == "Contact: 09\nReported concern: broken"


def test_strip_is_pythons(values):
    texts = ["\t a b \n", " x　", "", "  ", "\x1cq\x85"]
    assert values(T.strip, texts) == [t.strip() for t in texts]
    assert values(T.clean, texts) == [t.strip() or None for t in texts]


def test_fees_and_days(values):
    assert values(K.labor_fee, ["12.5", "abc", "", None, "1e3"]) == [Decimal("12.50"), None, None, None, Decimal("1000.00")]
    assert values(lambda c: K.day_key(c, "string"), ["2026-01-02 03:04:05", "2026", "", None]) == ["2026-01-02", "2026", None, None]


def test_names_and_roles(spark, values):
    df = spark.createDataFrame([("A", "B"), ("", "B"), (None, None)], "f string, l string")
    names = [r[0] for r in df.select(P.display_name(F.col("f"), F.col("l"), F.lit("m@x"))).collect()]
    assert names == ["A B", "B", "m@x"]
    assert values(P.norm_role, [" ADMIN ", "boss", None, ""]) == ["admin", "end_user", "end_user", "end_user"]
    assert values(lambda c: P.norm_role(c, F.lit("admin")), ["boss", None]) == ["admin", "admin"]
    assert values(P.role_label, ["super_admin", "admin", "x", None]) == ["Super Admin", "Admin", "End User", "End User"]
    assert values(P.role_title, ["power_user", "", None]) == ["Power User", "—", "—"]


def test_authority(spark):
    pairs = [(a, t) for a in P.ROLES for t in P.ROLES]
    df = spark.createDataFrame(pairs, "a string, t string")
    got = {(r.a, r.t): (r.m, r.s) for r in df.select("a", "t", P.can_manage(F.col("a"), F.col("t")).alias("m"), P.can_set_role(F.col("a"), F.col("t")).alias("s")).collect()}
    for actor, target in pairs:
        may = actor == "super_admin" or (actor == "admin" and target == "end_user")
        assert got[actor, target] == (may, may)


def test_pretty_json(values):
    assert values(J.pretty_json, ['{"b": 1, "a": [true]}', None, "{oops"]) == ['{"a":[true],"b":1}', "{}", "{oops"]


def test_printed_escapes(values):
    """Two- and eight-digit escapes become characters, however many backslashes stand before them."""
    texts = ["\x9b", "\U000e0001 end", "\\x41"] + ["\\" * n + "\x85" for n in (1, 2, 49, 50, 51, 60, 400)]
    got = values(lambda c: F.from_json(J.dict_to_json(c), "t string", J.DICT_OPTIONS)["t"], ["{'t': %r}" % t for t in texts])
    assert got == texts


def test_folded_comparison(values):
    assert values(lambda c: T.same_folded(c, "mesa"), ["Mesa", "MÉSA", "mesa ", None]) == [True, True, False, None]


def test_like(values):
    stores = ["Café Uno", "CAFE DOS", "50% off", "a_b", "axb", "", None]
    assert values(lambda c: T.matches_like(c, "cafe"), stores) == [True, True, False, False, False, False, None]
    assert values(lambda c: T.matches_like(c, "%"), stores) == [True] * 6 + [None]
    assert values(lambda c: T.matches_like(c, "CAFÉ _o"), stores) == [False, True, False, False, False, False, None]
    assert values(lambda c: T.matches_like(c, r"0\%"), stores) == [False, False, True, False, False, False, None]
    assert values(lambda c: T.matches_like(c, "a_b"), stores) == [False, False, False, True, True, False, None]
    assert values(lambda c: T.matches_like(c, r"a\_b"), stores) == [False, False, False, True, False, False, None]
    assert values(lambda c: T.matches_like(c, "\\"), ["a\\b", "ab"]) == [True, False]


def test_wildcards_never_lose_rows(values):
    """A text that holds a piece also matches it with a wildcard before, behind or inside."""
    stores = ["Straße 1", "strasse 1", "Ωmέga", "ΟΔΟΣ οδος", "Ünïté É", "e\u0301te\u0301", "İstanbul", "Йод", "plain", "50% off"]
    for text in ("strasse", "straße", "ε", "οδοσ", "ς", "unite", "été", "istanbul", "иод", "PLAIN", "e"):
        found = values(lambda c: T.matches_like(c, text), stores)
        wild = [values(lambda c: T.matches_like(c, w), stores) for w in (f"%{text}", f"{text}%", f"{text[:1]}%{text[1:]}")]
        assert any(found), text
        assert all(not hit or all(w[i] for w in wild) for i, hit in enumerate(found)), text
        assert wild[0] == wild[1] == found


def test_fees_out_of_range(values):
    texts = ["12.5", "999999999999", "-999999999999", "1e9", "free", "", None, "NaN", "Infinity", "99999999.99"]
    assert values(K.fee_out_of_range, texts) == [False, True, True, True] + [False] * 6


def test_user_transitions(spark):
    df = spark.createDataFrame([("admin", "end_user", True, False), ("x", "end_user", False, True)], "a string, b string, w boolean, n boolean")
    rows = df.select(P.role_transition(F.col("a"), F.col("b")), P.activity_transition(F.col("w"), F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("from Admin to End User", "deactivate"), (None, "activate")]
