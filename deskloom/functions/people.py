"""User columns: activity, roles, names and authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.text import either, strip, truthy

# Roles, highest first, and their labels.
ROLES = ("super_admin", "admin", "end_user")
ROLE_LABELS = {"super_admin": "Super Admin", "admin": "Admin", "end_user": "End User"}


def is_active(c: Column, data_type: str = "string") -> Column:
    """Activity from text, number or boolean; NULL is inactive."""
    if data_type in ("boolean",):
        active = c
    elif data_type in ("string",):
        active = F.lower(strip(c)).isin("1", "true", "yes")
    else:
        active = c != 0
    return F.coalesce(active, F.lit(False))


def norm_email(c: Column) -> Column:
    return F.lower(strip(c))


def norm_role(c: Column, fallback: Column | None = None) -> Column:
    """A known role, else ``fallback``, else end_user."""
    default = F.coalesce(truthy(fallback), F.lit("end_user")) if fallback is not None else F.lit("end_user")
    role = F.lower(strip(F.coalesce(truthy(c), default)))
    return F.when(role.isin(*ROLES), role).otherwise(default)


def role_label(c: Column) -> Column:
    """Label in the user list: anything but the two admin roles is an end user."""
    return (
        F.when(c == "super_admin", ROLE_LABELS["super_admin"])
        .when(c == "admin", ROLE_LABELS["admin"])
        .otherwise(ROLE_LABELS["end_user"])
    )


def role_title(c: Column) -> Column:
    """Label in the settings: other roles in title case, none as a dash."""
    return F.coalesce(F.initcap(F.replace(truthy(c), F.lit("_"), F.lit(" "))), F.lit("—"))


def display_name(first: Column, last: Column, email: Column) -> Column:
    return either(F.concat_ws(" ", truthy(first), truthy(last)), email)


def can_manage(actor_role: Column, target_role: Column) -> Column:
    """Super admins manage everyone, admins manage end users only."""
    rule = (actor_role == "super_admin") | ((actor_role == "admin") & (target_role == "end_user"))
    return F.coalesce(rule, F.lit(False))


def can_set_role(actor_role: Column, new_role: Column) -> Column:
    """Super admins assign every role, admins only end_user."""
    rule = ((actor_role == "super_admin") & new_role.isin(*ROLES)) | (
        (actor_role == "admin") & (new_role == "end_user")
    )
    return F.coalesce(rule, F.lit(False))


def role_transition(old: Column, new: Column) -> Column:
    """``from X to Y`` when the role label changes, else NULL."""
    before, after = role_label(old), role_label(new)
    return F.when(before != after, F.concat(F.lit("from "), before, F.lit(" to "), after))


def activity_transition(old: Column, new: Column) -> Column:
    """``activate`` or ``deactivate`` when a (boolean) activity changes, else NULL."""
    return F.when(old & ~new, "deactivate").when(~old & new, "activate")
