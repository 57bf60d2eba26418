"""Matching claims to confirmed moves, and lookups by nearest date and by history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.operators import pool_scan
from tidemark.shipping import ship
from tidemark.storage import BROADCAST_ROWS, sided, written


#: Stands for any club, or any season, in the key of a pool.
ANY = "*"
#: Stands for a missing season in the key of a pool.
UNDATED = "\x00"
#: A pool of a club and season with more moves meets its claims in blocks of names and cells; others are read as a whole, in parts
#: of at most so many pairs and claims.
WHOLE_POOL, PART_PAIRS, PART_CLAIMS = 10_000, 50_000_000, 100_000
#: The most that date, direction, kind and fee can add.
MOST_DATE, MOST_DIRECTION, MOST_KIND, MOST_FEE = 0.10, 0.08, 0.05, 0.08
#: The names of the signals, in the order of their options in scored_pairs.
REASONS = (("exact_player", "surname_player", "fuzzy_player"), ("exact_club", "club_alias"), ("season_match",), ("date_near",), ("direction_match", "direction_conflict"), ("type_match", "loan_match", "type_conflict"), ("fee_close", "fee_similar"))


def _first_of(options: list[tuple[Column, Column | float]]) -> tuple[Column, Column]:
    """(value, number) of the first option whose test holds; zero and NULL if none does."""
    value = name = None
    for i, (test, points) in enumerate(options):
        nth = F.lit(i).cast("byte")
        value, name = (F.when(test, points), F.when(test, nth)) if value is None else (value.when(test, points), name.when(test, nth))
    return F.coalesce(value.cast("double"), F.lit(0.0)), name


def _club_part() -> tuple[Column, Column]:
    known = F.coalesce(F.col("club"), F.lit("")) != ""
    alias = F.contains(text.alnum_unicode(F.col("m_club")), text.alnum_unicode(F.col("club")))
    return _first_of([(known & (F.col("club") == F.col("m_club")), 0.20), (known & alias, 0.10)])


def _season_part() -> tuple[Column, Column]:
    return _first_of([((F.coalesce(F.col("season"), F.lit("")) != "") & (F.col("season") == F.col("m_season")), 0.10)])


def _direction_part() -> tuple[Column, Column]:
    told = F.col("direction").isin("in", "out")
    return _first_of([(told & (F.col("direction") == F.col("m_direction")), MOST_DIRECTION), (told, -0.12)])


def _kind_part() -> tuple[Column, Column]:
    typed = F.col("kind") != "unclear"
    return _first_of([(typed & (F.col("kind") == F.col("m_kind")), MOST_KIND), (typed & (F.col("kind") == "loan") & F.col("m_loan"), 0.03), (typed, -0.05)])


def _fee_part(closeness: Column) -> tuple[Column, Column]:
    return _first_of([(closeness >= 0.8, MOST_FEE), (closeness >= 0.5, 0.04)])


def _shared() -> Column:
    return F.size(F.array_intersect("_w", "_mw"))


def _player_part() -> tuple[Column, Column]:
    exact = (F.col("_n") == F.col("_mn")) & (F.col("_n") != "")
    same_last = (F.col("_s") == F.col("_ms")) & (F.char_length("_s") >= 4)
    fuzzy = (_shared() > 0) & (_shared() / (F.size("_w") + F.size("_mw") - _shared()) >= 0.5)
    return _first_of([(exact, 0.45), (same_last, 0.25), (fuzzy, 0.15)])


def scored_pairs(pairs: DataFrame, *kept: str) -> DataFrame:
    """Score and signals of claims that stand beside a move, and the columns to keep. Pairs may have the points and the number of their
    player signal (see named_pairs)."""
    near = dates.proximity(F.abs(F.datediff("m_date", "published")))
    fee = scoring.fee_closeness(F.col("fee"), F.col("m_fee"))
    player = (F.col("_points"), F.col("_signal")) if "_signal" in pairs.columns else _player_part()
    parts = [player, _club_part(), _season_part(), _first_of([(near > 0, MOST_DATE * near)]), _direction_part(), _kind_part(), _fee_part(fee)]
    score = F.lit(0.0)
    for value, _ in parts:
        score = score + value
    return pairs.select("claim_id", "move_id", *kept, F.round(score, 6).alias("score"), *(name.alias(f"_o{i}") for i, (_, name) in enumerate(parts)))


def reasons() -> Column:
    """Names of the signals of a scored pair."""
    return F.array_compact(F.array(*(F.get(F.array(*map(F.lit, names)), F.col(f"_o{i}").cast("int")) for i, names in enumerate(REASONS))))


def _named(rows: DataFrame, player: str, n: str, w: str, s: str) -> DataFrame:
    rows = rows.withColumn(n, text.alnum_unicode(F.col(player)))
    rows = rows.withColumn(w, F.array_distinct(F.filter(F.split(n, " "), lambda x: x != "")))
    return rows.withColumn(s, F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")))


def _rowed(claims: DataFrame) -> DataFrame:
    """Claims with a number for each row (claim_ids may repeat), blank clubs and seasons as NULL."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    out = claims.withColumns({"club": blank("club"), "season": blank("season"), "_row": F.monotonically_increasing_id()})
    if "clubs" not in out.columns:
        out = out.withColumn("clubs", F.array().cast("array<string>"))
    if "related" not in out.columns:
        out = out.withColumn("related", F.lit(True))
    return out


def _numbered(claims: DataFrame, named: bool = True) -> DataFrame:
    """Claims, written, with a number for each row. Without names, only what pools need."""
    out = _rowed(claims)
    if not named:
        return written(out.select("_row", "claim_id", "club", "season", "clubs", "related"), "pool-claims")
    return written(_named(out.hint("rebalance"), "player", "_n", "_w", "_s"), "pool-claims")


def _pool_keys(claims: DataFrame) -> Column:
    """The keys of a row with club and season (k_club, k_season), of each kind that claims ask for: club and season, club, all."""
    asks = claims.agg(F.max(F.col("season").isNotNull()).alias("season"), F.max(F.col("season").isNull()).alias("any_season"), F.max(F.col("club").isNull()).alias("any_club")).first()
    kinds = [(F.col("club"), F.col("season"))] * bool(asks.season) + [(F.col("club"), F.lit(ANY))] * bool(asks.any_season) + [(F.lit(ANY), F.lit(ANY))] * bool(asks.any_club)
    return F.array(*(F.struct(c.alias("k_club"), s.alias("k_season")) for c, s in kinds or [(F.col("club"), F.col("season"))]))


def _counted_moves(moves: DataFrame, claims: DataFrame) -> DataFrame:
    """k_club, k_season and how many moves (n). Moves are counted by club and season first."""
    return _keyed_counts(moves.groupBy("club", "season").agg(F.count(F.lit(1)).alias("n")), claims)


def _keyed_counts(each: DataFrame, claims: DataFrame) -> DataFrame:
    keyed = each.select("n", F.inline(_pool_keys(claims))).where("k_club is not null and k_season is not null")
    return keyed.groupBy("k_club", "k_season").agg(F.sum("n").alias("n"))


def _keyed_moves(moves: DataFrame, claims: DataFrame) -> DataFrame:
    """Moves, once under each kind of pool key that claims ask for. They are written once, and keyed where they are read."""
    # Rebalanced, so that what is read several times lies in even files, whatever the files of the source are.
    rows = written(moves.hint("rebalance"), "pool-moves")
    keyed = rows.select("*", F.inline(_pool_keys(claims))).withColumnsRenamed({"club": "m_club", "season": "m_season"})
    return _named(keyed.where("k_club is not null and k_season is not null"), "m_player", "_mn", "_mw", "_ms")


def _pools(c: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pools, keys) of numbered claims and keyed or counted moves; see candidate_pools. keys: _row, k_club, k_season and how many
    moves (n, NULL for all)."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("club"), F.transform(F.coalesce("clubs", F.array().cast("array<string>")), lambda x: F.when(F.trim(x) != "", x)))))
    first = c.where("related").select("_row", F.explode(names).alias("k_club"), F.coalesce("season", F.lit(ANY)).alias("k_season"))
    counts = m if "n" in m.columns else m.groupBy("k_club", "k_season").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(counts, "pool-sizes")
    met = written(first.join(sizes.hint("merge"), ["k_club", "k_season"]), "pool-keys")
    every = sizes.where(F.col("k_club") == ANY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("every"))  # one row
    own = met.groupBy("_row").agg(F.sum("n").alias("own"))
    pools = c.select("_row", "claim_id", "club", "related").join(own.hint("merge"), "_row", "left").join(F.broadcast(every))
    open_club = F.col("club").isNull() & (F.col("every") > 0)
    kind = F.when(~F.col("related"), "unrelated").when(F.col("own").isNotNull(), "clubs").when(open_club, "all").otherwise("none")
    pools = written(pools.withColumn("pool", kind), "pools")
    n = F.when(F.col("pool") == "clubs", F.col("own")).when(F.col("pool") == "all", F.col("every")).otherwise(0).cast("bigint")
    anywhere = pools.where("pool = 'all'").select("_row", F.lit(ANY).alias("k_club"), F.lit(ANY).alias("k_season"))
    return pools.select("_row", "claim_id", "pool", n.alias("candidates")), met.select("_row", "k_club", "k_season", "n").unionByName(anywhere, allowMissingColumns=True)


def candidate_pools(claims: DataFrame, moves: DataFrame) -> DataFrame:
    """claim_id, pool and candidates (how many moves), a row for each claim.

    The pool of a related claim is the moves of its clubs (club and `clubs`) in its season, in all seasons where it names none.
    Where that is empty, a claim without a club of its own has all moves as its pool. No pairs are made for this: keys of
    claims meet counts of moves."""
    c = _numbered(claims, named=False)
    return _pools(c, _counted_moves(moves, c))[0].drop("_row")


#: A word that more than this many distinct names of moves hold, or one in 10,000 words, is a frequent one.
FREQUENT = 1_000


def _frequent(names: DataFrame) -> DataFrame:
    """One row: frequent words of the moves' names with how many names hold them. At most 10,000 by its bound."""
    words = names.select("_mn", "_mw").distinct().select(F.explode("_mw").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    words = written(words, "words")
    most = F.greatest(F.lit(FREQUENT), F.expr("sum(df) / 10000"))
    bound = words.agg(F.coalesce(most, F.lit(FREQUENT)).alias("most"))
    return written(words.join(F.broadcast(bound)).where("df > most").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("_df")), "frequent")


def _sizes(rows: DataFrame, words: str) -> list[int]:
    """Numbers of words that names have: few."""
    return sorted(r[0] for r in rows.select(F.size(words)).distinct().collect() if r[0] and r[0] > 0)


def _name_keys(words: Column, side: int, sizes: list[int]) -> Column:
    """The words whose blocks a name goes to, given its words, rare ones first; side 0: a claim's, 1: a move's; sizes: numbers of
    words of the other side.

    Two names share half of their words, taken together, only if they share (a + b) / 3 or more, where a and b are their numbers of
    words; so a rare one of the first a - (a + b) / 3 + 1 words of the one is among the first b - (a + b) / 3 + 1 of the other,
    whatever the order, if both sides have the same. Names of equal surnames meet by that."""
    size, last = F.size(words), F.col("_s" if side == 0 else "_ms")
    firsts = [F.lit(0)]
    for other in sizes:
        need = F.ceil((size + other) / 3).cast("int")
        firsts.append(F.when(need <= F.least(size, F.lit(other)), size - need + 1).otherwise(0))
    rare = F.coalesce(F.slice(words, 1, F.greatest(F.lit(0), *firsts)), F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.char_length(last) >= 4, F.concat(F.array(last), rare)).otherwise(rare))


def _rare_first(rows: DataFrame, words: str, frequent: DataFrame) -> DataFrame:
    """_o: the words of a name, frequent ones last, else in the order of their letters."""
    order = F.array_sort(F.transform(words, lambda w: F.struct(F.coalesce(F.try_element_at("_df", w), F.lit(0)).alias("df"), w.alias("word"))))
    return rows.join(F.broadcast(frequent)).withColumn("_o", F.transform(order, lambda x: x["word"])).drop("_df")


def named_pairs(claims: DataFrame, moves: DataFrame) -> DataFrame:
    """Claims beside the moves of their pool with a player signal, and its points and number (_points, _signal).

    Names of a pool are compared once, however many claims and moves bear them: pairs of names come from blocks of a surname or of a
    rare word; each has one block that owns it, that of the surname where both have it, else that of their rarest shared word. Claims
    and moves meet by these pairs. They have k_club, k_season and names (player, m_player)."""
    of = ["k_club", "k_season"]
    told = written(_named(claims.select(*of, "player").distinct(), "player", "_n", "_w", "_s"), "claim-names")
    known = written(_named(moves.select(*of, "m_player").distinct(), "m_player", "_mn", "_mw", "_ms"), "move-names")
    frequent = _frequent(known)
    keyed = lambda rows, words, side, sizes: _rare_first(rows, words, frequent).withColumn("word", F.explode(_name_keys(F.col("_o"), side, sizes)))
    left, right = keyed(told, "_w", 0, _sizes(known, "_mw")), keyed(known, "_mw", 1, _sizes(told, "_w")).drop("_o")
    met = left.join(right.hint("merge"), [*of, "word"])
    by_surname = (F.col("_s") == F.col("_ms")) & (F.char_length("_s") >= 4)
    by_word = ~by_surname & (F.get(F.array_intersect("_o", "_mw"), F.lit(0)) == F.col("word")) & (_shared() * 3 >= F.size("_w") + F.size("_mw"))
    points, signal = _player_part()
    names = met.where((by_surname & (F.col("word") == F.col("_s"))) | by_word).select(*of, "player", "m_player", points.alias("_points"), signal.alias("_signal"))
    names = written(names, "name-pairs")
    return claims.join(names.hint("merge"), [*of, "player"]).join(moves.drop("_mn", "_mw", "_ms").hint("merge"), [*of, "m_player"])


def _blocks(moves: DataFrame) -> DataFrame:
    """Moves of a pool that agree in club, season, direction, kind and month: the spans of their dates and fees."""
    by = ("k_club", "k_season", "m_club", "m_season", "m_direction", "m_kind", "m_loan", "month")
    paid = F.when(F.col("m_fee") > 0, F.col("m_fee"))
    club = F.when(F.col("k_club") == ANY, ANY).otherwise(F.col("m_club"))
    rows = moves.withColumns({"month": F.trunc("m_date", "month"), "m_club": club})
    return rows.groupBy(*by).agg(F.min("m_date").alias("d0"), F.max("m_date").alias("d1"), F.min(paid).alias("f0"), F.max(paid).alias("f1"))


#: Paid fees of one step differ by less than a fifth, so each is close to all others.
FEE_STEP = 1.2


def _digest(*keys: str) -> Column:
    """Keys may be NULL: blocks and cells are matched by a digest of them."""
    return F.xxhash64(*(x for k in keys for x in (F.col(k), F.col(k).isNull())))


#: What moves of a block agree in, besides the month and the club.
ALIKE = ("k_club", "k_season", "m_season", "m_direction", "m_kind", "m_loan")


def _in_steps(moves: DataFrame) -> DataFrame:
    return moves.withColumn("step", F.when(F.col("m_fee") > 0, F.floor(F.log("m_fee") / math.log(FEE_STEP))))


def _in_cells(moves: DataFrame) -> DataFrame:
    """Moves with their cell (_cell): moves of a pool that agree in club, season, direction, kind, day and step of fee."""
    return _in_steps(moves).withColumn("_cell", _digest(*ALIKE, "m_date", "step")).drop("step")


def _cells(moves: DataFrame) -> DataFrame:
    """Cells with their block (_k): how many moves they have, the least and the largest fee."""
    paid = F.when(F.col("m_fee") > 0, F.col("m_fee"))
    rows = _in_steps(moves).withColumn("m_club", F.when(F.col("k_club") == ANY, ANY).otherwise(F.col("m_club")))
    cells = rows.groupBy(*ALIKE, "m_club", "m_date", "step").agg(F.count(F.lit(1)).alias("n"), F.min(paid).alias("f0"), F.max(paid).alias("f1"))
    return cells.withColumn("month", F.trunc("m_date", "month")).withColumns({"_k": _digest(*ALIKE, "month"), "_cell": _digest(*ALIKE, "m_date", "step")}).drop("month", "step")


def _of_few(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among `keys`, by broadcast, where those are few, which is counted; else all rows."""
    return rows.join(F.broadcast(keys), on, "left_semi") if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def best_rivals(best: DataFrame, moves: DataFrame, close: float) -> DataFrame:
    """For claims whose pool may have a move without a player signal that comes within `close` of the best named pair: claim_id, the
    best score of such moves (rival), and whether one goes before the named pair (before). best: claims with keys, names, `top` and
    `top_id` (the best named pair) and `own` (the cells of the named moves of the row).

    A block of moves (a month) whose bound is lower stays closed. Of an open block, cells are scored, not moves: the ends of a cell's
    fees are fees of moves, and where both score alike all of the cell do. Only cells where that leaves a doubt are opened."""
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    room = F.lit(MOST_DATE) + part(F.col("club").isNotNull(), 0.20) + part(F.col("season").isNotNull(), 0.10) + part(F.col("direction").isin("in", "out"), MOST_DIRECTION) + part(F.col("kind") != "unclear", MOST_KIND) + part(F.col("fee") > 0, MOST_FEE)
    least = F.col("top") - close - 1e-9
    open_claims = best.where(room > least)
    blocks = written(_blocks(moves), "pool-blocks")
    met = open_claims.join(blocks.hint("merge"), ["k_club", "k_season"])
    away = F.greatest(F.datediff("d0", "published"), F.datediff("published", "d1"), F.lit(0))
    nearest = F.least(F.greatest("fee", "f0"), F.col("f1"))
    fee_part = lambda c: _fee_part(scoring.fee_closeness(F.col("fee"), c))[0]
    bound = _club_part()[0] + _season_part()[0] + MOST_DATE * dates.proximity(away) + _direction_part()[0] + _kind_part()[0] + fee_part(nearest)
    met = met.where(bound > least).withColumn("_k", _digest(*ALIKE, "month"))
    opened = written(met.drop("d0", "d1", "f0", "f1", "m_club", "m_season", "m_direction", "m_kind", "m_loan", "month"), "pool-opened")
    on = ["_k", "k_club", "k_season"]
    near = dates.proximity(F.abs(F.datediff("m_date", "published")))
    base = F.lit(0.0) + _club_part()[0] + _season_part()[0] + _first_of([(near > 0, MOST_DATE * near)])[0] + _direction_part()[0] + _kind_part()[0]
    ends = {"_base": base, "_own": F.size(F.filter("own", lambda x: x == F.col("_cell")))}
    cells = opened.join(written(_cells(moves), "pool-cells").hint("merge"), on).withColumns(ends)
    cells = cells.withColumns({"_a": F.round(F.col("_base") + fee_part(F.col("f0")), 6), "_b": F.round(F.col("_base") + fee_part(F.col("f1")), 6)}).withColumn("rival", F.greatest("_a", "_b"))
    cells = cells.where((F.col("rival") > least) & (F.col("n") > F.col("_own")))
    even, tied = F.col("_a") == F.col("_b"), F.col("rival") == F.col("top")
    # A named move adds its player signal, so a cell with one scores below `top` where it is even. Of a tie the move_ids tell.
    doubt = tied | (~even & (F.col("_own") > 0))
    known = cells.where(~doubt).select("claim_id", "rival", (F.col("rival") > F.col("top")).alias("before"))
    unsure = written(cells.where(doubt).select("claim_id", "player", "published", "club", "season", "direction", "kind", "fee", "top", "top_id", "k_club", "k_season", "_cell"), "pool-doubts")
    inside = ["_cell", "k_club", "k_season"]
    seen = _of_few(_in_cells(moves).drop("_mn", "_mw", "_ms"), unsure.select(*inside).distinct(), inside)
    pairs = unsure.join(seen.hint("merge"), inside)
    pairs = _named(_named(pairs, "player", "_n", "_w", "_s"), "m_player", "_mn", "_mw", "_ms").where(_player_part()[1].isNull())
    exact = F.round(base + fee_part(F.col("m_fee")), 6)
    seen = pairs.withColumn("rival", exact).where(F.col("rival") > least).select("claim_id", "rival", ((F.col("rival") > F.col("top")) | (tied & (F.col("move_id") < F.col("top_id")))).alias("before"))
    # Two aggregates over plain values: tasks send one row a claim.
    some = [t.groupBy("claim_id").agg(F.max("rival").alias("rival"), F.max("before").alias("before")) for t in (known, seen)]
    return some[0].unionByName(some[1]).groupBy("claim_id").agg(F.max("rival").alias("rival"), F.max("before").alias("before"))


def _spots(keys: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spots, crowded): spots are rows of claims with each club and season of their pool, the number of parts that it is read in (0: in
    blocks) and their part; crowded are pools of 0 or several parts. Those are few: one in WHOLE_POOL moves, one in some 5,000 claims."""
    near = keys.where(F.col("k_club") != ANY)
    dated = near.where(F.col("k_season") != ANY)
    seasons = each.select(F.col("club").alias("k_club"), F.coalesce("season", F.lit(UNDATED)).alias("k_season"), "n")
    always = near.where(F.col("k_season") == ANY).select("_row", "k_club").join(seasons.hint("merge"), "k_club")
    spots = written(dated.unionByName(always), "pool-spots")
    pools = spots.groupBy("k_club", "k_season").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("asked"))
    parts = F.when(F.col("n") > WHOLE_POOL, 0).otherwise(F.ceil(F.greatest(F.col("n") * F.col("asked") / PART_PAIRS, F.col("asked") / PART_CLAIMS))).cast("int")
    crowded = written(pools.select("k_club", "k_season", parts.alias("parts")).where("parts <> 1").coalesce(1), "pool-crowded")
    rows = spots.join(F.broadcast(crowded), ["k_club", "k_season"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("_row"), F.col("parts"))).otherwise(0).cast("int")), crowded


def _scanned_pools(claims: DataFrame, moves: DataFrame, spots: DataFrame, crowded: DataFrame, close: float) -> DataFrame:
    """What pool_scan.scanned finds for claims in pools that are read as a whole: moves and claims go to their pool once."""
    ship(claims.sparkSession)
    ids = dict(claims.dtypes)["claim_id"], dict(moves.dtypes)["move_id"]
    day = lambda c: F.unix_date(F.col(c).cast("date")).alias("day")
    m = moves.where("club is not null").withColumns({"k_club": F.col("club"), "k_season": F.coalesce("season", F.lit(UNDATED))})
    m = m.join(F.broadcast(crowded), ["k_club", "k_season"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).where("parts > 0")
    m = m.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("k_club", "k_season", "part", F.lit(0).cast("byte").alias("side"), F.lit(None).cast(ids[0]).alias("claim_id"), "move_id", text.alnum_unicode(F.col("m_player")).alias("name"), day("m_date"), F.col("m_direction").alias("direction"), F.col("m_kind").alias("kind"), F.col("m_loan").alias("loan"), F.col("m_fee").cast("double").alias("fee"), F.lit(None).cast("byte").alias("o1"), F.lit(None).cast("byte").alias("o2"))
    c = claims.join(spots.where("parts > 0").select("_row", "k_club", "k_season", "part").hint("merge"), "_row").withColumns({"m_club": F.col("k_club"), "m_season": F.col("k_season")})
    c = c.select("k_club", "k_season", "part", F.lit(1).cast("byte").alias("side"), "claim_id", F.lit(None).cast(ids[1]).alias("move_id"), text.alnum_unicode(F.col("player")).alias("name"), day("published"), "direction", "kind", F.lit(None).cast("boolean").alias("loan"), F.col("fee").cast("double").alias("fee"), _club_part()[1].alias("o1"), _season_part()[1].alias("o2"))
    rows = m.unionByName(c).repartition("k_club", "k_season", "part").withColumn("h", F.xxhash64("k_club", "k_season", "part")).sortWithinPartitions("h")
    rows = rows.withColumnsRenamed({"k_club": "club", "k_season": "season"})
    options = ", ".join(f"_o{i} byte" for i in range(7))
    return rows.mapInArrow(pool_scan.scanned(round(close * 100)), f"claim_id {ids[0]}, move_id {ids[1]}, score double, next double, {options}, other double, other_id {ids[1]}")


def _wide_moves(moves: DataFrame, crowded: DataFrame, everywhere: bool) -> DataFrame:
    """Moves of pools that are met in blocks: those of large pools, and all of them where claims ask for all."""
    large = crowded.where("parts = 0").select("k_club", "k_season", F.lit(True).alias("large"))
    season = F.coalesce("season", F.lit(UNDATED))
    rows = moves.withColumns({"k_club": F.col("club"), "k_season": season}).join(F.broadcast(large), ["k_club", "k_season"], "left")
    own, all_ = (F.struct(k.alias("k_club"), s.alias("k_season")) for k, s in ((F.col("club"), season), (F.lit(ANY), F.lit(ANY))))
    keys = F.array_compact(F.array(F.when(F.col("large"), own), *([all_] if everywhere else [])))
    return rows.drop("k_club", "k_season").select("*", F.inline(keys)).drop("large").withColumnsRenamed({"club": "m_club", "season": "m_season"})


def best_matches(claims: DataFrame, moves: DataFrame, least: float = 0.45, close: float = 0.07) -> DataFrame:
    """One row per claim: move_id (NULL if none), score, reasons, ambiguous, candidates and status. claims: claim_id, player, club,
    season, published, direction, kind, fee and, where known, clubs (other clubs named) and related. moves: move_id, m_player,
    club, season, m_date, m_direction, m_kind, m_loan, m_fee.

    Moves and claims of a club and season meet in arrays of a task (pool_scan). In pools that are too large for that, and where a claim's
    pool are all moves, pairs are made only of names that are alike (named_pairs), and other moves are scored in cells (best_rivals)."""
    asked = ("claim_id", "player", "club", "season", "published", "direction", "kind", "fee")
    c = written(_rowed(claims).select("_row", *asked, "clubs", "related"), "pool-claims", compression="zstd")
    m = written(moves.select("move_id", "m_player", "club", "season", "m_date", "m_direction", "m_kind", "m_loan", "m_fee"), "pool-moves", compression="zstd")
    each = written(m.groupBy("club", "season").agg(F.count(F.lit(1)).alias("n")), "pool-counts")
    pools, keys = _pools(c, _keyed_counts(each, c))
    spots, crowded = _spots(keys, each)
    c = c.select("_row", *asked)
    met = _scanned_pools(c, m, spots, crowded, close)
    anywhere = keys.where(F.col("k_club") == ANY).select("_row", "k_club", "k_season")
    everywhere = not pools.where("pool = 'all'").isEmpty()
    if wide := everywhere or not crowded.where("parts = 0").isEmpty():
        met = written(met, "pool-scan")
        mw = _wide_moves(m, crowded, everywhere)
        cw = c.join(spots.where("parts = 0").select("_row", "k_club", "k_season").unionByName(anywhere).hint("merge"), "_row")
        cw = written(cw, "wide-claims")
        named = written(scored_pairs(_in_cells(named_pairs(cw, mw)), "_row", "_cell"), "named-pairs")
        met = met.unionByName(named.drop("_row", "_cell"), allowMissingColumns=True)
    # Rows that share a claim_id are one claim told several times, and a claim may have several clubs and seasons.
    own, whole = Window.partitionBy("claim_id").orderBy(F.desc_nulls_last("score"), "move_id"), Window.partitionBy("claim_id")
    ranked = met.withColumns({"k": F.row_number().over(own), "after": F.lead("score").over(own), "top": F.first("score").over(own), "top_id": F.first("move_id").over(own)})
    ahead = (F.col("other") > F.col("top")) | ((F.col("other") == F.col("top")) & (F.col("other_id") < F.col("top_id")))
    ranked = ranked.withColumns({"before": F.coalesce(F.max(ahead).over(whole), F.lit(False)), "second": F.max(F.greatest("next", "other", "after")).over(whole)})
    first = ranked.where("k = 1 and score is not null").select("claim_id", "move_id", "score", *(f"_o{i}" for i in range(7)), "before", "second")
    if wide:
        first = written(first, "named-best")
        cells = named.groupBy("_row").agg(F.collect_list("_cell").alias("own"))
        top = first.select("claim_id", F.col("score").alias("top"), F.col("move_id").alias("top_id"))
        best = cw.join(top.hint("merge"), "claim_id").join(cells.hint("merge"), "_row", "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
        rivals = best_rivals(best.drop("_row"), mw, close).withColumnRenamed("before", "goes_before")
        first = first.join(rivals.hint("merge"), "claim_id", "left").withColumns({"before": F.col("before") | F.coalesce("goes_before", F.lit(False)), "second": F.greatest("second", "rival")})
    out = pools.withColumn("candidates", F.sum("candidates").over(whole)).join(first.hint("merge"), "claim_id", "left")
    status = (
        F.when(F.col("pool") == "unrelated", "not_transfer_related")
        .when(F.col("candidates") == 0, "no_candidates")
        .when(F.col("_o0").isNull() | F.col("before"), "missing_player_signal")
        .when(F.col("score") < least, "score_below_threshold")
        .otherwise("matched")
    )
    unsure = F.coalesce(F.round(F.col("score") - F.col("second"), 6) < close, F.lit(False))
    found = F.col("status") == "matched"
    return out.withColumn("status", status).select(
        "claim_id",
        F.when(found, F.col("move_id")).alias("move_id"),
        F.when(found, F.col("score")).otherwise(0.0).alias("score"),
        F.when(found, F.array_join(reasons(), "|")).alias("reasons"),
        (found & unsure).cast("int").alias("ambiguous"),
        "candidates",
        "status",
    )


def nearest(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, tie: list[str]) -> DataFrame:
    """left with the row of right that has the same key and the nearest date (ties: by `tie`). Two ordered windows find the
    neighbours on both sides; no pairs are made."""
    cols = [c for c in right.columns if c != key]
    r = right.select(key, F.col(right_date).alias("_d"), F.lit(1).alias("_k"), F.struct(*cols).alias("_r"))
    first = r.groupBy(key, "_d", "_k").agg(F.min_by("_r", F.struct(*(F.col("_r")[t] for t in tie))).alias("_r"))  # one row per date
    l = left.select("*", F.col(left_date).alias("_d"), F.lit(0).alias("_k"))
    up, down = Window.partitionBy(key).orderBy("_d", "_k"), Window.partitionBy(key).orderBy(F.desc("_d"), F.desc("_k"))
    running = (Window.unboundedPreceding, 0)  # frames that grow by a row at a time
    both = l.unionByName(first, allowMissingColumns=True)
    both = both.withColumns({"_after": F.last("_r", True).over(down.rowsBetween(*running)), "_before": F.last("_r", True).over(up.rowsBetween(*running))}).where("_k = 0")
    gap = lambda c: F.abs(F.datediff(F.col(c)[right_date], left_date))
    order = lambda c: F.struct(gap(c).alias("g"), *(F.col(c)[t].alias(t) for t in tie))
    pick = F.when(F.col("_before").isNull() | (F.col("_after").isNotNull() & (order("_after") < order("_before"))), F.col("_after")).otherwise(F.col("_before"))
    return both.withColumn("_hit", pick).select(*left.columns, *(F.col("_hit")[c].alias(c) for c in cols))


def loan_kinds(moves: DataFrame, most_days: int = 400) -> DataFrame:
    """permanent, loan or loan_return. moves: move_id, player_id, date, from_id, to_id, fee. A move without a fee returns the
    latest earlier one without a fee in the opposite direction, if that is at most `most_days` old."""
    free = moves.where("coalesce(fee, 0) = 0 and from_id <> to_id")
    w = Window.partitionBy("player_id", F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).orderBy("date", "from_id", "to_id", "move_id").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("move_id", "date")
    up = F.col("from_id") < F.col("to_id")
    opposite = F.when(up, F.last(F.when(~up, here), True).over(w)).otherwise(F.last(F.when(up, here), True).over(w))
    paired = free.withColumn("prior", opposite).where(F.datediff("date", F.col("prior.date")) <= most_days).select("move_id", F.col("prior.move_id").alias("prior_id"))
    returns, loans = paired.select("move_id", F.lit("loan_return").alias("kind")), paired.select(F.col("prior_id").alias("move_id"), F.lit("loan").alias("kind"))
    tags = returns.unionByName(loans).groupBy("move_id").agg(F.max("kind").alias("kind"))  # loan_return goes before loan
    return moves.join(tags, "move_id", "left").withColumn("kind", F.coalesce("kind", F.lit("permanent")))


def reputation(claims: DataFrame) -> DataFrame:
    """Claims, matches, rates and scores of every source, reporter, and club with reporter, in one pass. claims: source,
    journalist, club, matched (boolean), match_score. Blank sources and reporters have no row of their own."""
    sets = claims.groupingSets([["source"], ["journalist"], ["club", "journalist"]], "source", "journalist", "club")
    stats = sets.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_claims"), F.count_if("matched").alias("n_matched"), F.avg("match_score").alias("avg_match_score"))
    grain = F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "journalist").otherwise("club_journalist")
    out = stats.withColumns({"grain": grain, "match_rate": F.col("n_matched") / F.col("n_claims"), "smoothed_rate": scoring.smoothed(F.col("n_matched"), F.col("n_claims"), 0.5)})
    blank = ((F.col("grain") == "source") & (F.coalesce("source", F.lit("")) == "")) | ((F.col("grain") == "journalist") & (F.coalesce("journalist", F.lit("")) == ""))
    return out.where(~blank).select("grain", "source", "journalist", "club", "n_claims", "n_matched", "match_rate", "smoothed_rate", "avg_match_score")


def first_wins(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of tables in order of priority; the first row of a key stays. `origin` names its table."""
    both = None
    for rank, (name, df) in enumerate(parts):
        part = df.withColumns({"origin": F.lit(name), "_rank": F.lit(rank)})
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    k = F.row_number().over(Window.partitionBy(key).orderBy("_rank"))
    return both.withColumn("_k", k).where("_k = 1").drop("_k", "_rank")


def credibility(claims: DataFrame, stats: DataFrame, prior: Column) -> DataFrame:
    """Seven weighted components for each claim. claims: source, journalist, club, rumor_stage, article_kind, days (to the
    match, NULL if none), related, ambiguous; prior: the source's prior score."""
    stats = written(stats, "reputation")
    # Rows of each grain are counted: few sources and reporters are broadcast, whatever share of the claims one of them has.
    part = lambda grain, keys, name: sided(stats.where(F.col("grain") == grain).select(*keys, F.struct("n_claims", "n_matched", "avg_match_score").alias(name)))
    j = claims.withColumn("prior", prior)
    for grain, keys, name in (("source", ["source"], "s"), ("journalist", ["journalist"], "j"), ("club_journalist", ["club", "journalist"], "c")):
        j = j.join(part(grain, keys, name), keys, "left")
    rate = lambda n, base: F.when(F.col(n).isNotNull(), scoring.smoothed(F.col(n)["n_matched"], F.col(n)["n_claims"], base))
    base = F.col("prior")
    reporter = 0.7 * F.coalesce(rate("j", base), base) + 0.3 * base
    j = j.withColumn("reporter", reporter)
    history = F.coalesce((rate("s", base) + rate("j", base)) / 2, rate("s", base), rate("j", base), F.lit(0.5))
    own = F.coalesce(0.6 * rate("c", F.col("reporter")) + 0.4 * F.col("c")["avg_match_score"], 0.5 * rate("j", F.col("reporter")) + 0.5 * F.col("j")["avg_match_score"], F.lit(0.5))
    w = scoring.CREDIBILITY_WEIGHTS
    score = (
        w["source"] * base
        + w["journalist"] * F.col("reporter")
        + w["conversion"] * history
        + w["club"] * own
        + w["stage"] * scoring.lookup(F.col("rumor_stage"), scoring.STAGE_SCORES, 0.4)
        + w["article"] * scoring.lookup(F.col("article_kind"), scoring.ARTICLE_SCORES, 0.5)
        + w["timing"] * dates.confirmation(F.abs(F.col("days")))
    )
    score = F.when(F.col("related"), score).otherwise(F.least(score * 0.35, F.lit(0.2))) * F.when(F.col("ambiguous"), 0.9).otherwise(1.0)
    support = F.coalesce(F.col("s")["n_claims"], F.lit(0)) + F.coalesce(F.col("j")["n_claims"], F.lit(0))
    notes = F.array_compact(F.array(F.when(~F.col("related"), "not_transfer_related"), F.when(F.col("days").isNull(), "unmatched_claim"), F.when(F.col("article_kind") == "live_blog", "live_blog_penalty"), F.when(F.col("ambiguous"), "ambiguous_match"), F.when(support < 3, "low_history_support")))
    return j.withColumns({"credibility": scoring.clamp(score), "history": history, "own": own, "notes": notes})
