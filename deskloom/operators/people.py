"""User listings, account requests, edits and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import people as P
from deskloom.functions.text import folded, same_folded, strip, truthy
from deskloom.operators.changes import last_edits
from deskloom.operators.filters import visible_users
from deskloom.operators.numbering import first_per_key
from deskloom.operators.schema_ops import data_type

# Messages.
_EXISTS = "An account with that email already exists."
_ROLE = "You cannot assign that role."
_NO_EDIT = "User not found or you cannot edit this user."
_NO_DELETE = "User not found or you cannot delete this user."
_SELF = "You cannot delete your own account."
_NAMES = "First name and last name are required."
_LAST = "Cannot delete the last super admin."


def user_list(users: DataFrame) -> DataFrame:
    """Users by role rank and name, activity decoded."""
    decoded = users.withColumn("is_active", P.is_active(F.col("is_active"), data_type(users, "is_active")))
    order = [
        (~same_folded(F.col("role"), "super_admin")).asc_nulls_first(),
        (~same_folded(F.col("role"), "admin")).asc_nulls_first(),
        folded(F.col("last_name")).asc_nulls_first(),
        folded(F.col("first_name")).asc_nulls_first(),
        F.asc("id"),
    ]
    return decoded.orderBy(*order)


def user_cards(users: DataFrame, viewer_role: str) -> DataFrame:
    """The list as ``viewer_role`` sees it, with display name and role label."""
    return user_list(visible_users(users, viewer_role)).select(
        "id",
        "email",
        P.display_name(F.col("first_name"), F.col("last_name"), F.col("email")).alias("display_name"),
        P.role_label(F.col("role")).alias("role_label"),
        P.role_title(F.col("role")).alias("role_title"),
        "is_active",
    )


def manageable(users: DataFrame) -> DataFrame:
    """Per user, which roles may manage it: the authority rules as columns, without a join."""
    return users.select(
        "id",
        "role",
        *[P.can_manage(F.lit(r), F.col("role")).alias(f"by_{r}") for r in P.ROLES],
    )


def super_admin_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(same_folded(F.col("role"), "super_admin")).alias("super_admins"))


def check_new_users(requests: DataFrame, users: DataFrame, register: bool = False) -> DataFrame:
    """Account requests, cleaned, with the reason for refusal as ``error`` (NULL if accepted).

    Self-registration always gives an end user. Of several acceptable requests for one email the
    first one wins, as if they came one after the other.
    """
    role = F.lit("end_user") if register else P.norm_role(F.col("role"))
    incomplete = F.lit(False)
    for c in ("first_name", "last_name", "email"):
        incomplete = incomplete | F.col(c).isNull() | (F.col(c) == "")
    message = "Please fill in all fields." if register else "Please fill in all required fields."
    allowed = F.lit(True) if register else P.can_set_role(F.col("actor_role"), F.col("role"))
    cleaned = requests.withColumns(
        {
            "first_name": strip(F.col("first_name")),
            "last_name": strip(F.col("last_name")),
            "email": P.norm_email(F.col("email")),
            "role": role,
        }
    ).withColumn("error", F.when(~allowed, _ROLE).when(incomplete, message))
    # Who claims an email: a user, or the first acceptable request. One email on very many requests
    # is cut to one row per task before it is shuffled, and each request meets one claim.
    email = folded(F.col("email"))
    asked = cleaned.where(F.col("error").isNull()).select(email.alias("_email"), F.col("row_num").alias("_first"))
    first = first_per_key(asked, [F.col("_email")], [F.asc("_first")])
    known = users.select(email.alias("_email"), F.lit(None).alias("_first"))
    claims = first.unionByName(known).groupBy("_email").agg(
        F.min("_first").alias("_first"), (F.count("_first") < F.count("*")).alias("_known")
    )
    matched = cleaned.join(claims, email == F.col("_email"), "left")
    mine = ~F.coalesce("_known", F.lit(False)) & F.col("_first").eqNullSafe(F.col("row_num"))
    return matched.withColumn("error", F.coalesce("error", F.when(~mine, _EXISTS))).drop("_email", "_first", "_known")


def new_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests whose email no user has yet: an anti join on the folded email."""
    wanted = requests.withColumn("email", P.norm_email(F.col("email")))
    return wanted.join(users.select(folded(users["email"]).alias("_email")), folded(wanted["email"]) == F.col("_email"), "left_anti")


def dedupe_users(requests: DataFrame) -> DataFrame:
    """The first request per email."""
    wanted = requests.withColumn("email", P.norm_email(F.col("email")))
    return first_per_key(wanted, [folded(F.col("email"))], [F.asc("row_num")])


def check_user_edits(edits: DataFrame, users: DataFrame) -> DataFrame:
    """Account edits with the normalised role and the reason for refusal as ``error``.

    Each edit is judged by itself against ``users``; ``apply_user_updates`` takes them in turn.
    """
    known = users.select("id", F.col("role").alias("_old"), F.lit(True).alias("_known"))
    joined = edits.join(known, "id", "left")
    role = P.norm_role(F.coalesce(truthy(F.col("role")), F.col("_old")), F.col("_old"))
    cleaned = joined.withColumns(
        {
            "first_name": strip(F.col("first_name")),
            "last_name": strip(F.col("last_name")),
            "role": role,
            "is_active": F.col("is_active") == "1",
            "_manage": F.col("_known").isNotNull() & P.can_manage(F.col("actor_role"), F.col("_old")),
        }
    )
    missing = _unnamed("first_name") | _unnamed("last_name")
    error = (
        F.when(~F.col("_manage"), _NO_EDIT)
        .when(~P.can_set_role(F.col("actor_role"), F.col("role")), _ROLE)
        .when(missing, _NAMES)
    )
    return cleaned.withColumn("error", error).drop("_old", "_known", "_manage")


def _unnamed(c: str) -> Column:
    return truthy(strip(F.col(c))).isNull()


_KINDS = ("sets", "keeps", "blank", "admin")


def _deciding_edits(edits: DataFrame, order: list[str]) -> DataFrame:
    """Per user the last edit of each kind, as a struct ``_<kind>``.

    What an edit does depends on the role before it only through these kinds: ``sets`` is a super
    admin's edit with a known role, which is accepted in every state; ``keeps`` and ``blank`` are
    those with an unknown role and without any, which leave the role; ``admin`` is an admin's edit
    that could apply to an end user, whose role it leaves. So at most four rows per user meet,
    however many edits one user has.
    """
    asked = F.lower(strip(F.col("role")))
    asked = F.when(asked.isin(*P.ROLES), asked)
    by_super = F.when(asked.isNotNull(), "sets").when(truthy(F.col("role")).isNull(), "blank").otherwise("keeps")
    by_admin = F.when(F.coalesce(asked, F.lit("end_user")) == "end_user", "admin")
    kind = F.when(F.col("actor_role") == "super_admin", by_super).when(F.col("actor_role") == "admin", by_admin)
    named = edits.where(~(_unnamed("first_name") | _unnamed("last_name")) & kind.isNotNull())
    last = first_per_key(named.withColumn("_kind", kind), [F.col("id"), F.col("_kind")], [F.desc(c) for c in order])
    edit = F.struct(
        F.struct(*order).alias("at"), strip(F.col("first_name")).alias("first_name"), strip(F.col("last_name")).alias("last_name"),
        asked.alias("role"), F.when(F.col("is_active") == "1", "1").otherwise("0").alias("is_active"),
    )
    return last.groupBy("id").agg(*[F.first(F.when(F.col("_kind") == k, edit), ignorenulls=True).alias(f"_{k}") for k in _KINDS])


def _later(a: Column, b: Column) -> Column:
    """The later of two edits, either of which may be missing."""
    return F.when(b.isNull() | (a["at"] > b["at"]), a).otherwise(b)


def _replaced(users: DataFrame, joined: DataFrame, values: dict[str, Column], changed: Column) -> DataFrame:
    """The columns of ``users`` from ``joined``, some with other values in changed rows."""
    return joined.select(
        *[
            F.when(changed, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name)
            for f in users.schema.fields
        ]
    )


def apply_user_updates(users: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """All users, with edits of name, role and activity applied one after the other.

    Every edit is judged by the role that the edits before it left. Users come with the columns
    ``first_name, last_name, role, is_active``.
    """
    joined = users.join(_deciding_edits(edits, order), "id", "left")
    old, (sets, keeps, blank, admin) = F.col("role"), (F.col(f"_{k}") for k in _KINDS)
    # Without an edit that sets the role, one that leaves it is accepted if the role is a known one
    # (or none, which counts as end user), or becomes one by a blank edit, which normalises it.
    plain = F.lower(strip(old)).isin(*P.ROLES)
    accepted = truthy(old).isNull() | old.isin(*P.ROLES) | (plain & blank.isNotNull())
    kept = _later(keeps, blank)
    by_super = F.when(sets.isNotNull(), _later(sets, kept)).when(accepted, kept)
    role = F.when(sets.isNotNull(), sets["role"]).when(by_super.isNotNull(), P.norm_role(old, old)).otherwise(old)
    staged = joined.withColumns({"_super": by_super, "_role": role})
    by_super, role = F.col("_super"), F.col("_role")
    # From then on the role stays, so admins' edits are accepted if it is end user.
    after = admin.isNotNull() & (role == "end_user") & (by_super.isNull() | (admin["at"] > by_super["at"]))
    staged = staged.withColumn("_edit", F.when(after, admin).otherwise(by_super))
    values = {c: F.col("_edit")[c] for c in ("first_name", "last_name", "is_active")} | {"role": F.col("_role")}
    changed = F.col("_edit").isNotNull()
    return _replaced(users, staged, values, changed)


def check_profile_edits(edits: DataFrame) -> DataFrame:
    """Users' edits of their own names, stripped, with the reason for refusal as ``error``."""
    error = F.when(_unnamed("first_name") | _unnamed("last_name"), _NAMES)
    return edits.withColumn("error", error).withColumns({c: strip(F.col(c)) for c in ("first_name", "last_name")})


def apply_profile_updates(users: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """All users, with the last accepted edit of their own names; role and activity stay."""
    last = last_edits(check_profile_edits(edits.select("id", *order, "first_name", "last_name")), "id", order)
    packed = last.select("id", F.struct("first_name", "last_name").alias("_edit"))
    values = {c: F.col("_edit")[c] for c in ("first_name", "last_name")}
    return _replaced(users, users.join(packed, "id", "left"), values, F.col("_edit").isNotNull())


def user_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Users whose role label or activity changed, with the confirmation texts."""
    active = P.is_active(F.col("is_active"), data_type(old, "is_active"))
    before = old.select("id", F.col("role").alias("old_role"), active.alias("was"))
    active = P.is_active(F.col("is_active"), data_type(new, "is_active"))
    after = new.select("id", F.col("role").alias("new_role"), active.alias("now"))
    role = P.role_transition(F.col("old_role"), F.col("new_role"))
    activity = P.activity_transition(F.col("was"), F.col("now"))
    labelled = before.join(after, "id").select("id", role.alias("role_change"), activity.alias("activity_change"))
    return labelled.where(F.col("role_change").isNotNull() | F.col("activity_change").isNotNull())


def check_user_deletes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Delete requests with the reason for refusal as ``error``.

    If the batch would take the last super admin, the request that would do so is refused.
    """
    actors = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role"))
    targets = users.select(
        F.col("id").alias("target_id"), F.col("role").alias("target_role"), F.lit(True).alias("_known")
    )
    joined = requests.join(actors, "actor_id", "left").join(targets, "target_id", "left")
    found = F.col("_known").isNotNull() & P.can_manage(F.col("actor_role"), F.col("target_role"))
    error = F.when(F.col("actor_id") == F.col("target_id"), _SELF).when(~found, _NO_DELETE)
    checked = joined.withColumn("error", error)
    taken = (
        checked.where(F.col("error").isNull() & (F.col("target_role") == "super_admin"))
        .groupBy("target_id")
        .agg(F.min("seq").alias("seq"))
    )
    # If all super admins are taken, the one taken last stays.
    last = taken.agg(
        F.when(F.count("*") >= super_admin_count(users).scalar(), F.max_by("target_id", "seq")).alias("kept")
    ).scalar()
    refused = F.when(F.col("target_id") == last, _LAST)
    return checked.withColumn("error", F.coalesce("error", refused)).select(
        "seq", "actor_id", "target_id", "error"
    )


def apply_user_deletes(users: DataFrame, requests: DataFrame) -> DataFrame:
    accepted = check_user_deletes(requests, users).where(F.col("error").isNull())
    return users.join(accepted.select(F.col("target_id").alias("id")), "id", "left_anti")
