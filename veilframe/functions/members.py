"""Who the caller is: tests of group membership, decided when the plan is built or for each row."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.model import PolicyError

T = TypeVar("T")
#: A fixed set of groups, or an array column that holds the groups of each row's caller.
Caller = Collection[str] | Column


def member(caller: Caller, principals: Sequence[str]) -> bool | Column:
    """Is the caller in any of the groups?"""
    if isinstance(caller, Column):
        return F.coalesce(F.arrays_overlap(caller, F.array(*map(F.lit, principals))), F.lit(False))
    return bool(set(caller) & set(principals))


def dispatch(entries: Sequence[T], caller: Caller, build: Callable[[T], Column]) -> Column:
    """The first entry that names the caller decides; the last one, which names nobody, decides for the rest."""
    if not entries or getattr(entries[-1], "principals"):  # noqa: B009
        raise PolicyError("the last entry must be for everybody else")
    if any(not e.principals for e in entries[:-1]):
        raise PolicyError("only the last entry can be for everybody else")
    if not isinstance(caller, Column):
        return build(next(e for e in entries if not e.principals or member(caller, e.principals)))
    if len(entries) == 1:
        return build(entries[0])
    out = F
    for e in entries[:-1]:
        out = out.when(member(caller, e.principals), build(e))
    return out.otherwise(build(entries[-1]))


def groups_of(user_groups: DataFrame, user: str | Column | None = None, user_col: str = "user", group_col: str = "group") -> DataFrame:
    """One row: the groups of ``user`` (default: the session's user) as array ``groups``, empty if there are none."""
    who = F.session_user() if user is None else F.lit(user) if isinstance(user, str) else user
    return user_groups.where(F.col(user_col) == who).agg(F.sort_array(F.collect_set(group_col)).alias("groups"))


def groups_by_user(user_groups: DataFrame, user_col: str = "user", group_col: str = "group") -> DataFrame:
    """One row for each user: ``principal, groups``."""
    return user_groups.groupBy(F.col(user_col).alias("principal")).agg(F.sort_array(F.collect_set(group_col)).alias("groups"))


def distinct_groups(user_groups: DataFrame, group_col: str = "group") -> DataFrame:
    return user_groups.select(F.col(group_col).alias("group")).distinct().orderBy("group")
