"""Dirty bitmaps as rows of granules, and their directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEAN_SLATE = {"granularity": 65536, "enabled": True, "in_use": False}


def merge_outcome(directory: DataFrame, destination: str, source: str) -> DataFrame:
    """Why a merge can't be done, first reason first, or ``ok``. A bitmap may be merged into itself."""
    def one(name: str, column: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    facts = directory.agg(one(destination, "granularity").alias("dg"), one(source, "granularity").alias("sg"), one(destination, "in_use").alias("du"), one(source, "in_use").alias("su"))
    return facts.select(F.expr("case when dg is null then 'no_destination' when sg is null then 'no_source' when du or su then 'in_use' when dg <> sg then 'granularity' else 'ok' end").alias("outcome"))


def merge(dirty: DataFrame, destination: str, source: str) -> DataFrame:
    """The destination's granules after the merge: the union of both."""
    return dirty.filter(F.col("bitmap").isin(destination, source)).select(F.lit(destination).alias("bitmap"), "granule").distinct()


def packed(dirty: DataFrame, word: int = 32) -> DataFrame:
    """Granules as words of bits; words of different bitmaps merge by ``bit_or``."""
    return dirty.groupBy("bitmap", F.expr(f"granule div {word}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(granule % {word} as int))")).alias("bits"))


def apply_actions(directory: DataFrame, actions: DataFrame) -> DataFrame:
    """The directory after an ordered list of actions per bitmap name.

    Each name's actions are one short list, folded in order: add needs a free name,
    the others an entry; the first failure of a name ends its list. Clear keeps the
    entry. Rows ``(name, exists, enabled, clears, error)``.
    """
    step = """aggregate(acts, named_struct('here', here0, 'on', on0, 'clears', 0L, 'err', cast(null as string)), (s, a) ->
      case when s.err is not null then s
        when a.action = 'add' then if(s.here, named_struct('here', true, 'on', s.on, 'clears', s.clears, 'err', 'exists'), named_struct('here', true, 'on', true, 'clears', 0L, 'err', cast(null as string)))
        when not s.here then named_struct('here', false, 'on', false, 'clears', s.clears, 'err', 'missing')
        when a.action = 'remove' then named_struct('here', false, 'on', false, 'clears', s.clears, 'err', cast(null as string))
        when a.action = 'clear' then named_struct('here', true, 'on', s.on, 'clears', s.clears + 1L, 'err', cast(null as string))
        when a.action = 'enable' then named_struct('here', true, 'on', true, 'clears', s.clears, 'err', cast(null as string))
        else named_struct('here', true, 'on', false, 'clears', s.clears, 'err', cast(null as string)) end)"""
    lists = actions.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("acts"))
    start = directory.select("name", F.lit(True).alias("had"), F.col("enabled").alias("was_on"))
    both = lists.join(start, "name", "full_outer").select("name", F.coalesce("acts", F.expr("array()").cast("array<struct<seq:bigint,action:string>>")).alias("acts"), F.coalesce("had", F.lit(False)).alias("here0"), F.coalesce("was_on", F.lit(False)).alias("on0"))
    return both.select("name", F.expr(step).alias("s")).select("name", F.col("s.here").alias("exists"), F.col("s.on").alias("enabled"), "s.clears", F.col("s.err").alias("error"))


def add_refusal(bits: Column, name: Column, granularity: Column, count: Column, exists: Column) -> Column:
    """Why a bitmap can't be added, in the order that the checks are made."""
    power = F.bit_count(granularity) == 1
    return F.when(bits != 16, "refcount_width").when(~F.octet_length(name).between(1, 1023), "name_length").when(~power | ~granularity.between(1 << 9, 1 << 31), "granularity").when(count >= 65535, "too_many").when(exists, "duplicate").otherwise("ok")


def default_granularity(cluster: Column) -> Column:
    return F.greatest(F.lit(4096), F.least(F.lit(65536), cluster))


def replaced(directory: DataFrame, entries: DataFrame) -> DataFrame:
    """The directory with the entries of the same names replaced; others change nothing."""
    new = entries.select("name", *(F.col(c).alias(f"new_{c}") for c in directory.columns if c != "name"), F.lit(True).alias("found"))
    both = directory.join(new, "name", "left")
    return both.select(*(F.col(c) if c == "name" else F.when(F.col("found"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in directory.columns), F.coalesce("found", F.lit(False)).alias("replaced"))
