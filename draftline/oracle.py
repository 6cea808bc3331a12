"""The registered queries in plain SQL, for checking against another engine."""

from __future__ import annotations

from .schema import DRAFT, raw_struct
from .sources.match_view import MATCH_VIEW_CTES, PERIOD, VERSIONS_CTE, VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF, WIDE_VIEW_CTE

_IDS, _NAMES = DRAFT.pick_ids(), DRAFT.pick_names()
_PICKS = ", ".join(f"m.{i}, m.{n}" for i, n in zip(_IDS, _NAMES))
_FULL = " AND ".join(f"{i} > 0 AND {n} IS NOT NULL" for i, n in zip(_IDS, _NAMES))
_TIME = "match_start_date_time"

_LATEST = f"""
eligible AS (
  SELECT * FROM match_view
  WHERE winner_id IN (radiant_team_id, dire_team_id) AND game_version_id IS NOT NULL
    AND {_FULL} AND len(list_distinct([{", ".join(_IDS)}])) = 10),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY match_id ORDER BY {_TIME} DESC, game_version_id DESC NULLS LAST) AS rn
    FROM eligible)
  WHERE rn = 1)"""
_LABEL = """CASE WHEN m.winner_id = m.radiant_team_id THEN TRUE
       WHEN m.winner_id = m.dire_team_id THEN FALSE END AS radiant_win"""
_MATCHES = f"""
matches AS (
  SELECT m.match_id, m.{_TIME}, m.game_version_id, v.name AS game_version, {_PICKS}, {_LABEL}
  FROM latest m LEFT JOIN versions v ON m.game_version_id = v.id)"""
_SPLIT = f"""
split_matches AS (
  SELECT *, CAST(radiant_win AS INT) AS y,
    CASE WHEN {_TIME} <= TIMESTAMP '{VIEW_TRAIN_CUTOFF}' THEN 'train'
         WHEN {_TIME} <= TIMESTAMP '{VIEW_VALIDATION_CUTOFF}' THEN 'validation' ELSE 'test' END AS split
  FROM matches),
split_names AS (SELECT * FROM (VALUES ('train', 1), ('validation', 2), ('test', 3)) t(split, o))"""


def _picks(source: str, keep: str) -> str:
    parts = [
        f"SELECT {keep}, {side}_player_{slot}_hero_id AS hero_id, {side}_player_{slot}_hero AS hero_name, "
        f"'{side.title()}' AS side, {slot} AS slot FROM {source}"
        for side in DRAFT.sides
        for slot in range(1, 6)
    ]
    return " UNION ALL ".join(parts)


_PICKS_CTE = f"\npicks AS ({_picks('split_matches', f'match_id, {_TIME}, split')})"
_VOCABULARY = """
known_heroes AS (SELECT DISTINCT hero_id FROM picks WHERE split = 'train'),
known_patches AS (SELECT DISTINCT game_version_id FROM split_matches WHERE split = 'train'),
unseen AS (SELECT * FROM picks WHERE hero_id NOT IN (SELECT hero_id FROM known_heroes)),
unseen_rows AS (SELECT * FROM split_matches WHERE game_version_id NOT IN (SELECT game_version_id FROM known_patches))"""
_ENCODED = """
cells AS (
  SELECT match_id, split, concat('hero_', hero_id) AS feature, CASE WHEN max(side) = 'Dire' AND min(side) = 'Dire' THEN -1
      WHEN min(side) = 'Radiant' THEN 1 ELSE -1 END AS value
  FROM picks WHERE hero_id IN (SELECT hero_id FROM known_heroes) GROUP BY match_id, split, hero_id
  UNION ALL
  SELECT match_id, split, concat('unknown_', lower(side), '_hero_count'), CAST(count(*) AS INT)
  FROM unseen GROUP BY match_id, split, side
  UNION ALL
  SELECT match_id, split, CASE WHEN game_version_id IN (SELECT game_version_id FROM known_patches)
      THEN concat('patch_', game_version_id) ELSE 'patch_unknown' END, 1
  FROM split_matches),
width AS (SELECT (SELECT count(*) FROM known_heroes) + 3 + (SELECT count(*) FROM known_patches) AS w)"""

_LEVELS = [MATCH_VIEW_CTES, VERSIONS_CTE, _LATEST, _MATCHES, _SPLIT, _PICKS_CTE, _VOCABULARY, _ENCODED]


_FEATURES = """
features AS (
  SELECT concat('hero_', hero_id) AS feature, row_number() OVER (ORDER BY hero_id) - 1 AS i FROM known_heroes
  UNION ALL SELECT 'unknown_radiant_hero_count', (SELECT count(*) FROM known_heroes)
  UNION ALL SELECT 'unknown_dire_hero_count', (SELECT count(*) FROM known_heroes) + 1
  UNION ALL SELECT concat('patch_', game_version_id), (SELECT count(*) FROM known_heroes) + 1 + row_number() OVER (ORDER BY game_version_id) FROM known_patches
  UNION ALL SELECT 'patch_unknown', (SELECT w - 1 FROM width))"""


def _sql(level: int, text: str, *more: str) -> str:
    return "WITH " + ",".join([*_LEVELS[: level + 1], *more]) + "\n" + text


def _view(text: str, *more: str) -> str:
    return _sql(0, text, *more)


def _m(text: str, *more: str) -> str:
    return _sql(3, text, *more)


def _s(text: str, *more: str) -> str:
    return _sql(4, text, *more)


def _p(text: str, *more: str) -> str:
    return _sql(5, text, *more)


def _v(text: str, *more: str) -> str:
    return _sql(6, text, *more)


def _e(text: str, *more: str) -> str:
    return _sql(7, text, *more)


_VIEW_COLUMNS = ["match_id", _TIME, "game_version_id", "radiant_team_id", "dire_team_id", "winner_id", *_IDS, *_NAMES]


def _nulls(source: str, columns: list[str], percent: bool = True) -> str:
    """Null counts of each column as rows."""
    rate = ", round(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2), 6) AS null_percent" if percent else ""
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count{rate.format(c=c)} FROM {source}"
        for i, c in enumerate(columns, start=1)
    )


# Fixed values, written out by hand and not taken from the library's rules: groups, decisions, reasons.
_ROLE_TABLE = """
role_names(k, column_group, v1_decision, reason) AS (VALUES
  (1, 'target source', 'target_derivation_only', 'Directly identifies the winner; use it only to create radiant_win, then remove it.'),
  (2, 'target mapping', 'target_derivation_only', 'Needed to map winner_id to Radiant or Dire; excluded from the draft-only model.'),
  (3, 'identifier', 'tracking_only', 'Useful for deduplication and tracing a row, but an arbitrary ID is not a feature.'),
  (4, 'time', 'split_only', 'Use for the chronological split, not as a direct model feature.'),
  (5, 'pre-match context', 'use_feature', 'The game patch is known before the match and changes hero balance.'),
  (6, 'draft', 'use_feature', 'The selected hero is known when the draft ends and is a primary model input.'),
  (7, 'draft label', 'display_only', 'Human-readable duplicate of hero_id; keep for inspection, not as a second model feature.'),
  (8, 'post-match result', 'exclude_leakage', 'Created during or after the match and would reveal information unavailable at draft time.'),
  (9, 'role assignment', 'exclude_leakage_risk', 'May be assigned or inferred using match play; exclude until its timestamp and origin are verified.'),
  (10, 'player identity', 'exclude_scope', 'Potentially known before the match, but high-cardinality identity features complicate a simple draft model.'),
  (11, 'team identity', 'exclude_scope', 'Known before the match, but excluded so the baseline measures draft information rather than team reputation.'),
  (12, 'competition metadata', 'exclude_scope', 'Mostly available before the match, but not necessary for the smallest useful draft-only baseline.'),
  (13, 'other', 'review_before_use', 'Outside the baseline scope; verify availability before considering it as a feature.'))"""
_ROLE_NUMBER = r"""CASE
    WHEN "column" = 'winner_id' THEN 1
    WHEN regexp_full_match("column", '(radiant|dire)_team_id') THEN 2
    WHEN "column" = 'match_id' THEN 3
    WHEN "column" = 'match_start_date_time' THEN 4
    WHEN "column" = 'game_version_id' THEN 5
    WHEN regexp_full_match("column", '(radiant|dire)_player_[1-5]_hero_id') THEN 6
    WHEN regexp_full_match("column", '(radiant|dire)_player_[1-5]_hero') THEN 7
    WHEN regexp_full_match("column", 'match_duration_seconds|first_blood_time_seconds|(radiant|dire)_kills') THEN 8
    WHEN regexp_full_match("column", '(radiant|dire)_player_[1-5]_(kills|deaths|assists|networth)') THEN 8
    WHEN regexp_full_match("column", '(radiant|dire)_player_[1-5]_(position|lane|role)') THEN 9
    WHEN regexp_full_match("column", '(radiant|dire)_player_[1-5]_(id|name)') THEN 10
    WHEN regexp_full_match("column", '(radiant|dire)_team_name') THEN 11
    WHEN regexp_full_match("column", 'league|league_.*|series_(id|type)') THEN 12
    ELSE 13 END"""


def _inventory(source: str, columns: list[str], *more: str) -> tuple[str, ...]:
    """CTEs ending in `inventory`: null profile and role of every column."""
    profile = f"\nprofile AS ({_nulls(source, columns)})"
    joined = f"\ninventory AS (SELECT p.*, r.column_group, r.v1_decision, r.reason FROM profile p JOIN role_names r ON r.k = {_ROLE_NUMBER})"
    return (*more, _ROLE_TABLE, profile, joined)


def _sample(rows: int) -> str:
    chosen = f"""
chosen AS (SELECT match_id FROM latest ORDER BY md5(CAST(match_id AS VARCHAR)) LIMIT {rows})"""
    return _m("SELECT m.* FROM matches m JOIN chosen USING (match_id)", chosen)


def _key_sample(table: str, key: str, columns: str, rows: int) -> str:
    return (
        f"SELECT {columns} FROM {table} WHERE {key} IN "
        f"(SELECT {key} FROM (SELECT DISTINCT {key} FROM {table}) ORDER BY md5(CAST({key} AS VARCHAR)) LIMIT {rows})"
    )


def _boundaries(source: str, column: str) -> str:
    return f"""
ranked AS (SELECT {column} AS t, row_number() OVER (ORDER BY {column}) AS r, count(*) OVER () AS n FROM {source}),
cuts AS (
  SELECT min(CASE WHEN r = CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT) THEN t END) AS train_cutoff,
         min(CASE WHEN r = CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN t END) AS validation_cutoff
  FROM ranked)"""


def _quality(source: str, columns: list[str], expected_rows: str, expected_columns: str, order: str = "match_id") -> str:
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    bad = " + ".join(f"CAST(coalesce({c} <= 0, FALSE) AS INT)" for c in _IDS)
    facts = f"""
facts AS (SELECT count(*) AS n, CAST(sum({missing}) AS BIGINT) AS missing,
    count(*) FILTER (WHERE {_TIME} IS NULL) AS dates, CAST(sum({bad}) AS BIGINT) AS ids,
    count(*) FILTER (WHERE len(list_distinct([{", ".join(_IDS)}])) <> 10) AS drafts,
    count(*) FILTER (WHERE radiant_win) AS yes, count(*) FILTER (WHERE NOT radiant_win) AS no,
    count(*) - count(DISTINCT match_id) AS repeated FROM {source}),
steps AS (SELECT {_TIME} < lag({_TIME}) OVER (ORDER BY {order}, {_TIME}) AS down FROM {source}),
sorted AS (SELECT count(*) FILTER (WHERE down) = 0 AS ok FROM steps)"""

    def zero(name: str, value: str) -> str:
        return f"SELECT '{name}' AS \"check\", CAST({value} AS VARCHAR) AS observed, '0' AS expected, {value} = 0 AS passed FROM facts"

    parts = [
        f"SELECT 'Expected rows loaded' AS \"check\", CAST(n AS VARCHAR) AS observed, CAST({expected_rows} AS VARCHAR) AS expected, n = {expected_rows} AS passed FROM facts",
        f"SELECT 'Expected columns loaded', '{len(columns)}', '{expected_columns}', {len(columns)} = {expected_columns}",
        zero("Duplicate match IDs", "repeated"),
        zero("Missing cells", "missing"),
        zero("Invalid dates", "dates"),
        zero("Non-positive hero IDs", "ids"),
        zero("Rows without 10 unique heroes", "drafts"),
        "SELECT 'Binary target', CAST(yes > 0 AND no > 0 AS VARCHAR), 'true', yes > 0 AND no > 0 FROM facts",
        "SELECT 'Chronologically sorted', CAST(ok AS VARCHAR), 'true', ok FROM sorted",
    ]
    return facts + ",\nchecks AS (" + " UNION ALL ".join(parts) + ")"


_STATUS = "SELECT *, CASE WHEN passed THEN 'PASS' ELSE 'REVIEW' END AS status FROM checks"
_SCORED = """
scored AS (SELECT split, y AS label,
  CAST((radiant_player_1_hero_id * 37) % 101 * 9 + 50 AS DOUBLE) / 1000.0 AS p FROM split_matches)"""
_LINES = """scored AS (SELECT l_linestatus AS status, CAST(l_returnflag = 'R' AS INT) AS label,
  l_extendedprice / (l_extendedprice + CAST(50000.0 AS DOUBLE)) AS p FROM lineitem)"""
_DOCS = """scored AS (SELECT quality AS label,
  CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000.0) AS p FROM labels JOIN documents USING (doc_id))"""


def _auc_ctes(group: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    by = f"{group}, " if group else ""
    return f"""
counts AS (SELECT {by}p, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY {by}p),
running AS (SELECT *, sum(neg) OVER ({part}ORDER BY p) AS cum_neg,
    sum(pos) OVER ({part}ORDER BY p DESC) AS down_pos, sum(neg) OVER ({part}ORDER BY p DESC) AS down_neg FROM counts)"""


_AUC = "round(CAST(sum(pos * (cum_neg - neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc"
_ACC = "round(CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE neg END) AS DOUBLE) / sum(pos + neg), 6) AS accuracy"
_LOSS = "round(sum(-(pos * ln(p) + neg * ln(1 - p))) / sum(pos + neg), 6) AS log_loss"


def _metrics(ctes: str, group: str, builder=None) -> str:
    by = f"{group}, " if group else ""
    text = f"SELECT {by}CAST(sum(pos + neg) AS BIGINT) AS rows, {_ACC}, {_AUC}, {_LOSS} FROM running" + (f" GROUP BY {group}" if group else "")
    return builder(text, ctes, _auc_ctes(group)) if builder else f"WITH {ctes},{_auc_ctes(group)} {text}"


def _confusion(by: str) -> str:
    """All four cells, also the empty ones."""
    groups = f"(SELECT DISTINCT {by} FROM scored) g CROSS JOIN " if by else ""
    match = f"s.{by} = g.{by} AND " if by else ""
    column = f"g.{by}, " if by else ""
    return (
        f"SELECT {column}c.actual, c.predicted, count(s.label) AS rows FROM {groups}"
        "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(actual, predicted) "
        f"LEFT JOIN scored s ON {match}s.label = c.actual AND CAST(s.p >= 0.5 AS INT) = c.predicted "
        f"GROUP BY {column}c.actual, c.predicted"
    )


_ROW_FACTS = """
per_row AS (SELECT match_id, split,
    count(*) AS nonzero,
    sum(CASE WHEN starts_with(feature, 'hero_') THEN 1 WHEN starts_with(feature, 'unknown_') THEN value ELSE 0 END) AS picks,
    sum(CASE WHEN starts_with(feature, 'patch_') THEN value ELSE 0 END) AS flags,
    bool_and(CASE WHEN starts_with(feature, 'hero_') THEN value IN (-1, 1) ELSE TRUE END) AS signed
  FROM cells GROUP BY match_id, split)"""
_PRE_CHECKS = """
  SELECT 'No missing feature values' AS "check", count(*) FILTER (WHERE value IS NULL) = 0 AS passed FROM cells
  UNION ALL SELECT 'No duplicate feature columns', TRUE
  UNION ALL SELECT 'Hero values are -1, 0, or 1', bool_and(signed) FROM per_row
  UNION ALL SELECT 'Every row accounts for 10 hero picks', bool_and(picks = 10) FROM per_row
  UNION ALL SELECT 'Exactly one patch feature per row', bool_and(flags = 1) FROM per_row
  UNION ALL SELECT '{forbidden}', count(*) FILTER (WHERE feature IN ('match_id', 'split', 'radiant_win', 'winner_id')) = 0 FROM cells
  UNION ALL SELECT 'Feature and target indexes align', count(*) FILTER (WHERE y IS NULL) = 0 FROM split_matches"""
_FORBIDDEN = "No forbidden fields in feature matrix"


def _unseen_catalog(order: str) -> str:
    ranked = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY hero_id, hero_name ORDER BY {order}) AS rn FROM unseen WHERE hero_name IS NOT NULL)"""
    return _v(
        """SELECT hero_id, hero_name, max(CASE WHEN rn = 1 THEN split END) AS first_seen_split,
        count(*) AS picks, min(match_id) AS first_match_id FROM ordered GROUP BY hero_id, hero_name""",
        ranked,
    )


_SIDE_ORDER = "CASE side WHEN 'Radiant' THEN 0 ELSE 1 END, slot"
_FREQUENCY = """
frequency AS (SELECT hero_id, hero_name, count(*) AS picks,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM split_matches), 6) AS match_share
  FROM picks WHERE hero_id IS NOT NULL AND hero_name IS NOT NULL GROUP BY hero_id, hero_name)"""
_PATCHES = """
patches AS (SELECT game_version_id, game_version, count(*) AS matches,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM matches), 6) AS share
  FROM matches WHERE game_version_id IS NOT NULL AND game_version IS NOT NULL GROUP BY 1, 2)"""
_TARGET = """
target AS (SELECT 'Radiant win' AS result, count(*) FILTER (WHERE radiant_win) AS matches,
      round(CAST(count(*) FILTER (WHERE radiant_win) AS DOUBLE) / count(*), 6) AS share FROM matches
  UNION ALL
  SELECT 'Dire win', count(*) FILTER (WHERE NOT radiant_win),
      round(CAST(count(*) FILTER (WHERE NOT radiant_win) AS DOUBLE) / count(*), 6) FROM matches)"""
_STAMP = "'%Y-%m-%d %H:%M:%S'"
_SUMMARY = f"""count(*) AS matches, min({_TIME}) AS first_match, max({_TIME}) AS last_match"""

_WIDE_COLUMNS = [f.name for f in raw_struct()] + ["weather"]
_BOTH = (
    _SCORED,
    """
both_scored AS (
  SELECT 'Logistic regression' AS model, split, label, p FROM scored
  UNION ALL SELECT 'Dummy prior', split, y, (SELECT avg(y) FROM split_matches WHERE split = 'train') FROM split_matches),
both_counts AS (SELECT model, split, p, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM both_scored GROUP BY 1, 2, 3),
both_running AS (SELECT *, sum(neg) OVER (PARTITION BY model, split ORDER BY p) AS cum_neg FROM both_counts),
measured AS (SELECT model, split,
    CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE neg END) AS DOUBLE) / sum(pos + neg) AS accuracy,
    CAST(sum(pos * (cum_neg - neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc,
    sum(-(pos * ln(p) + neg * ln(1 - p))) / sum(pos + neg) AS log_loss
  FROM both_running GROUP BY 1, 2)""",
)
_BOTH_METRICS = (
    "SELECT model, split, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc, round(log_loss, 6) AS log_loss FROM measured"
)
_PRIOR_METRICS = """SELECT 'Dummy prior' AS model, split,
        round(avg(CASE WHEN CAST(prior >= 0.5 AS INT) = y THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
        CAST(0.5 AS DOUBLE) AS roc_auc,
        round(avg(-(y * ln(prior) + (1 - y) * ln(1 - prior))), 6) AS log_loss
        FROM split_matches, (SELECT avg(y) AS prior FROM split_matches WHERE split = 'train') GROUP BY split"""
_NAMED_MEANS = f"""
means AS (SELECT hero_id, round(avg(radiant_win::INT), 6) AS coefficient FROM picks JOIN matches USING (match_id)
  WHERE side = 'Radiant' GROUP BY 1),
hero_names AS (SELECT hero_id, hero_name FROM (SELECT *, row_number() OVER (
    PARTITION BY hero_id ORDER BY {_SIDE_ORDER}, picks.{_TIME}, match_id) AS rn FROM picks) WHERE rn = 1),
named AS (SELECT CAST(m.hero_id AS INT) AS index, concat('hero_', m.hero_id) AS feature, m.hero_id, n.hero_name, m.coefficient
  FROM means m LEFT JOIN hero_names n USING (hero_id))"""


def _corners(group: str) -> str:
    return f"""SELECT {group}, round(p, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
          SELECT *, CAST(down_neg AS DOUBLE) / sum(neg) OVER (PARTITION BY {group}) AS fpr,
            CAST(down_pos AS DOUBLE) / sum(pos) OVER (PARTITION BY {group}) AS tpr,
            lead(pos) OVER (PARTITION BY {group} ORDER BY p DESC) AS next_pos,
            lead(neg) OVER (PARTITION BY {group} ORDER BY p DESC) AS next_neg,
            row_number() OVER (PARTITION BY {group} ORDER BY p DESC) AS place FROM running)
        WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
        UNION ALL SELECT DISTINCT {group}, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM running"""


def _of(model: str, split: str, metric: str) -> str:
    return f"(SELECT {metric} FROM measured WHERE model = '{model}' AND split = '{split}')"


def _newton(steps: int) -> str:
    """Newton's method for |w|^2 / 2 + 0.01 * sum(loss) with two features and a bias, one CTE per step.

    The three equations of a step are solved by Cramer's rule; rows are counted by value first.
    """
    ctes = [
        """
points AS (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x1, CAST(l_discount AS DOUBLE) * 10 AS x2, count(*) AS n,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS pos FROM lineitem GROUP BY 1, 2)""",
        "\nw0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c)",
    ]
    for k in range(steps):
        ctes.append(f"""
s{k} AS (SELECT x1, x2, a, b, c, 0.01 * n / (1 + exp(-(a * x1 + b * x2 + c))) - 0.01 * pos AS g,
    0.01 * n / (1 + exp(-(a * x1 + b * x2 + c))) / (1 + exp(a * x1 + b * x2 + c)) AS h FROM points, w{k}),
e{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
    any_value(a) + sum(g * x1) AS g1, any_value(b) + sum(g * x2) AS g2, any_value(c) + sum(g) AS g3,
    1 + sum(h * x1 * x1) AS m11, sum(h * x1 * x2) AS m12, sum(h * x1) AS m13,
    1 + sum(h * x2 * x2) AS m22, sum(h * x2) AS m23, 1 + sum(h) AS m33 FROM s{k}),
d{k} AS (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det FROM e{k}),
w{k + 1} AS (SELECT
    a - (g1 * (m22 * m33 - m23 * m23) - m12 * (g2 * m33 - m23 * g3) + m13 * (g2 * m23 - m22 * g3)) / det AS a,
    b - (m11 * (g2 * m33 - m23 * g3) - g1 * (m12 * m33 - m23 * m13) + m13 * (m12 * g3 - g2 * m13)) / det AS b,
    c - (m11 * (m22 * g3 - g2 * m23) - m12 * (m12 * g3 - g2 * m13) + g1 * (m12 * m23 - m22 * m13)) / det AS c FROM d{k})""")
    last = f"w{steps}"
    return (
        "WITH " + ",".join(ctes) + f" SELECT 'quantity' AS feature, round(a, 4) AS weight FROM {last}"
        f" UNION ALL SELECT 'discount', round(b, 4) FROM {last} UNION ALL SELECT 'bias', round(c, 4) FROM {last}"
    )

_LATEST_EVENTS = """SELECT event_id, ts, user_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""

ORACLE_SQL: dict[str, str] = {
    # curation
    "curated_sample": _sample(30_000),
    "curated_small_sample": _sample(2000),
    "curated_all": _m("SELECT * FROM matches"),
    "keep_latest_matches": _sql(2, f"SELECT m.match_id, m.{_TIME}, m.game_version_id, m.winner_id, {_LABEL} FROM latest m"),
    "keep_latest_events": _LATEST_EVENTS,
    "keep_latest_events_bucketed": _LATEST_EVENTS,
    "hash_sample": _key_sample("orders", "o_orderkey", "o_orderkey, o_custkey, o_totalprice", 1000),
    "hash_sample_large": _key_sample("orders", "o_orderkey", "o_orderkey, o_custkey, o_totalprice", 5000),
    "hash_sample_repeated_key": _key_sample("lineitem", "l_partkey", "l_orderkey, l_linenumber, l_partkey", 150),
    # profiling
    "table_summary": _view(
        f"SELECT count(*) AS row_count, count(DISTINCT match_id) AS unique_key_count, min({_TIME}) AS min_time, max({_TIME}) AS max_time FROM match_view"
    ),
    "sample_summary": _m(
        f"""SELECT count(*) AS row_count, count(DISTINCT match_id) AS unique_key_count, min({_TIME}) AS min_time,
        max({_TIME}) AS max_time, round(round_even(avg(CAST(radiant_win AS INT)), 5), 6) AS label_rate FROM matches"""
    ),
    "null_profile": _view(_nulls("match_view", _VIEW_COLUMNS)),
    "null_profile_documents": _nulls("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    "column_inventory": _view("SELECT * FROM inventory", *_inventory("match_view", _VIEW_COLUMNS)),
    "role_summary": _view(
        f"""SELECT column_group, v1_decision, count(*) AS columns, min(position) AS first_position,
        string_agg("column", ', ' ORDER BY position) AS names FROM inventory GROUP BY 1, 2""",
        *_inventory("match_view", _VIEW_COLUMNS),
    ),
    "column_inventory_wide": _view("SELECT * FROM inventory", *_inventory("wide_view", _WIDE_COLUMNS, WIDE_VIEW_CTE)),
    "role_summary_wide": _view(
        """SELECT column_group, v1_decision, count(*) AS columns, min(position) AS first_position
        FROM inventory GROUP BY 1, 2""",
        *_inventory("wide_view", _WIDE_COLUMNS, WIDE_VIEW_CTE),
    ),
    "inventory_csv": _view(
        'SELECT "column", null_count, column_group, v1_decision, reason FROM inventory',
        *_inventory("wide_view", _WIDE_COLUMNS, WIDE_VIEW_CTE),
    ),
    "fingerprint": _m(
        """SELECT count(*) AS rows, CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS hash_sum
        FROM (SELECT md5(concat_ws('|', """
        + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in DRAFT.curated_columns())
        + ")) AS h FROM matches)"
    ),
    # sources and sinks
    "raw_matches": _view(f"SELECT match_id, {_TIME}, coalesce(game_version_id, -1) AS game_version_id, coalesce(winner_id, -1) AS winner_id FROM match_view"),
    "versions_csv": _sql(1, "SELECT id, name FROM versions"),
    "curated_csv": _m("SELECT * FROM matches"),
    "file_order_checks": _m(_STATUS, _quality("matches", DRAFT.curated_columns(), "n", "25", f"{_TIME}, match_id")),
    "metadata_json": _m(
        f"""SELECT r.raw_rows, r.raw_unique_matches, r.raw_date_min, r.raw_date_max, m.* FROM (
          SELECT count(*) AS raw_rows, count(DISTINCT match_id) AS raw_unique_matches,
          strftime(min({_TIME}), {_STAMP}) AS raw_date_min, strftime(max({_TIME}), {_STAMP}) AS raw_date_max FROM match_view) r,
        (SELECT count(*) AS actual_rows, strftime(min({_TIME}), {_STAMP}) AS date_min,
          strftime(max({_TIME}), {_STAMP}) AS date_max, CAST(25 AS INT) AS n_columns FROM matches) m"""
    ),
    "metrics_csv": _s(_BOTH_METRICS, *_BOTH),
    "curation_job": _sample(2000),
    "training_job_prior": _s(_PRIOR_METRICS),
    "binary_labels": _s("SELECT match_id, y AS label FROM split_matches"),
    "flipped_labels": _s("SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 1 - y ELSE y END AS label FROM split_matches"),
    "training_guards": _s(
        """SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, sum(y) > 0 AND sum(y) < count(*) AS trainable
        FROM split_matches GROUP BY 1"""
    ),
    "gate_checks_of_scores": _s(
        """SELECT 'Validation ROC-AUC above 0.5' AS "check", auc > 0.5 AS passed, CASE WHEN auc > 0.5 THEN 'PASS' ELSE 'STOP' END AS status FROM gate
        UNION ALL SELECT 'Validation Log Loss no worse than dummy', loss <= base, CASE WHEN loss <= base THEN 'PASS' ELSE 'STOP' END FROM gate""",
        *_BOTH,
        """
gate AS (SELECT max(roc_auc) FILTER (WHERE model = 'Logistic regression') AS auc,
    max(log_loss) FILTER (WHERE model = 'Logistic regression') AS loss, max(log_loss) FILTER (WHERE model = 'Dummy prior') AS base
  FROM measured WHERE split = 'validation')""",
    ),
    "metric_gaps_of_scores": _s(
        "SELECT "
        + ", ".join(
            [
                f"round({_of('Logistic regression', s, m)} - {_of('Dummy prior', s, m)}, 6) AS {s}_{m}_gain"
                for m in ("accuracy", "roc_auc", "log_loss")
                for s in ("validation", "test")
            ]
            + [
                f"round({_of('Logistic regression', 'validation', m)} - {_of('Logistic regression', 'test', m)}, 6) AS validation_test_{m}_gap"
                for m in ("accuracy", "roc_auc", "log_loss")
            ]
        ),
        *_BOTH,
    ),
    "metrics_by_auc_of_scores": _s(_BOTH_METRICS, *_BOTH),
    "named_means": _p("SELECT * FROM named", _NAMED_MEANS),
    "strongest_means": _p(
        """SELECT * FROM (SELECT * FROM named ORDER BY coefficient, index LIMIT 10)
        UNION ALL SELECT * FROM (SELECT * FROM named ORDER BY coefficient DESC, index LIMIT 10)""",
        _NAMED_MEANS,
    ),
    "encoded_vectors": _e(
        """SELECT c.match_id, CAST(max(w) AS INT) AS size, string_agg(concat(f.i, ':', c.value), ' ' ORDER BY f.i) AS cells
        FROM cells c JOIN features f USING (feature), width GROUP BY 1""",
        _FEATURES,
    ),
    "logistic_weights": _newton(12),
    "weight_slopes": _e(
        """SELECT CAST(i AS INT) AS index, feature, CAST(0 AS DOUBLE) AS slope FROM features
        UNION ALL SELECT CAST(w AS INT), 'bias', 0 FROM width""",
        _FEATURES,
    ),
    "evaluate_prior": _s(_PRIOR_METRICS),
    "matches_between": _s(
        f"SELECT match_id, {_TIME}, y AS label FROM split_matches WHERE {_TIME} BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"
    ),
    "missing_cells": _view(
        f"SELECT CAST(sum(null_count) AS BIGINT) AS missing_cells FROM ({_nulls('match_view', _VIEW_COLUMNS, percent=False)})"
    ),
    "missing_cells_curated": _m(
        f"SELECT CAST(sum(null_count) AS BIGINT) AS missing_cells FROM ({_nulls('matches', DRAFT.curated_columns(), percent=False)})"
    ),
    "dtype_summary": _m(
        'SELECT "column", CASE WHEN "column" = \'radiant_win\' THEN \'boolean\' '
        f"WHEN \"column\" = '{_TIME}' THEN 'timestamp_ntz' WHEN \"column\" = 'game_version_id' THEN 'int' "
        "WHEN ends_with(\"column\", '_id') THEN 'bigint' ELSE 'string' END AS type, null_count AS missing "
        f"FROM ({_nulls('matches', DRAFT.curated_columns(), percent=False)})"
    ),
    "repeated_keys": _view("SELECT count(*) - count(DISTINCT match_id) AS repeated_keys FROM match_view"),
    "repeated_keys_events": "SELECT count(*) - count(DISTINCT user_id) AS repeated_keys FROM events",
    "overview": _m(
        f"""SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM matches
        UNION ALL SELECT 'columns', '25'
        UNION ALL SELECT 'first_match', strftime(min({_TIME}), {_STAMP}) FROM matches
        UNION ALL SELECT 'last_match', strftime(max({_TIME}), {_STAMP}) FROM matches"""
    ),
    "metadata_record": _m(
        f"""SELECT r.*, s.*, '{",".join(DRAFT.curated_columns())}' AS columns FROM
        (SELECT count(*) AS raw_rows, count(DISTINCT match_id) AS raw_unique_matches,
           strftime(min({_TIME}), {_STAMP}) AS raw_date_min, strftime(max({_TIME}), {_STAMP}) AS raw_date_max FROM match_view) r,
        (SELECT CAST(30000 AS BIGINT) AS requested_rows, count(*) AS actual_rows, count(DISTINCT match_id) AS unique_matches,
           strftime(min({_TIME}), {_STAMP}) AS date_min, strftime(max({_TIME}), {_STAMP}) AS date_max,
           round(round_even(avg(CAST(radiant_win AS INT)), 6), 5) AS radiant_win_rate FROM matches) s"""
    ),
    # checks
    "quality_checks": _m(_STATUS, _quality("matches", DRAFT.curated_columns(), "n", "25")),
    "quality_checks_raw": _view(
        _STATUS,
        f"\nlabelled AS (SELECT *, {_LABEL} FROM match_view m)",
        _quality("labelled", [*_VIEW_COLUMNS, "radiant_win"], "15000", "27"),
    ),
    "order_breaks_repeated": """SELECT count(*) FILTER (WHERE down) AS breaks FROM (
        SELECT l_shipdate < lag(l_shipdate) OVER (ORDER BY l_orderkey, l_shipdate) AS down FROM lineitem)""",
    "order_breaks_raw": _view(
        f"""SELECT count(*) FILTER (WHERE down) AS breaks FROM (
        SELECT {_TIME} < lag({_TIME}) OVER (ORDER BY match_id, {_TIME}) AS down FROM match_view)"""
    ),
    "order_breaks": """SELECT count(*) FILTER (WHERE down) AS breaks FROM (
        SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS down FROM orders)""",
    "prefix_sums": """SELECT l_returnflag, l_shipdate, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS BIGINT) AS cum_n
        FROM (SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "split_checks": _s(
        _STATUS,
        f"""
checks AS (
  SELECT 'All rows assigned' AS "check", count(*) FILTER (WHERE split IS NULL) = 0 AS passed FROM split_matches
  UNION ALL SELECT 'Expected split labels', count(DISTINCT split) = 3 FROM split_matches
  UNION ALL SELECT 'Training ends before validation',
    max({_TIME}) FILTER (WHERE split = 'train') < min({_TIME}) FILTER (WHERE split = 'validation') FROM split_matches
  UNION ALL SELECT 'Validation ends before test',
    max({_TIME}) FILTER (WHERE split = 'validation') < min({_TIME}) FILTER (WHERE split = 'test') FROM split_matches)""",
    ),
    # exploration
    "target_distribution": _m("SELECT * FROM target", _TARGET),
    "majority_baseline": _m("SELECT max(share) AS majority_baseline FROM target", _TARGET),
    "matches_by_year": _m(f"SELECT CAST(year({_TIME}) AS INT) AS year, count(*) AS matches FROM matches GROUP BY 1"),
    "patch_distribution": _m("SELECT * FROM patches", _PATCHES),
    "top_patches": _m("SELECT * FROM patches ORDER BY matches DESC, game_version_id LIMIT 15", _PATCHES),
    "patch_count": _m("SELECT count(*) AS versions FROM patches", _PATCHES),
    "picks_long": _p("SELECT match_id, hero_id, hero_name, side, slot FROM picks"),
    "pick_frequency": _p("SELECT * FROM frequency", _FREQUENCY),
    "top_picks": _p("SELECT * FROM frequency ORDER BY picks DESC, hero_id LIMIT 20", _FREQUENCY),
    "side_frequency": _p(
        """SELECT hero_name, side, count(*) AS picks FROM picks WHERE hero_name IN
        (SELECT hero_name FROM frequency ORDER BY picks DESC, hero_id LIMIT 12) GROUP BY 1, 2""",
        _FREQUENCY,
    ),
    "first_rows": _m(f"SELECT * FROM matches ORDER BY {_TIME}, match_id LIMIT 3"),
    "hero_names": _p(
        f"""SELECT hero_id, hero_name FROM (SELECT *, row_number() OVER (
        PARTITION BY hero_id ORDER BY {_SIDE_ORDER}, {_TIME}, match_id) AS rn FROM picks) WHERE rn = 1"""
    ),
    "encoded_example": _p(
        f"""SELECT match_id, hero_id, hero_name, side, slot, CASE side WHEN 'Radiant' THEN 1 ELSE -1 END AS encoded_value
        FROM picks WHERE match_id = (SELECT match_id FROM split_matches WHERE split = 'train' ORDER BY {_TIME}, match_id LIMIT 1)"""
    ),
    # splits
    "split_boundaries": _m("SELECT * FROM cuts", _boundaries("matches", _TIME)),
    "split_boundaries_shipdate": f"WITH {_boundaries('lineitem', 'l_shipdate')} SELECT * FROM cuts",
    "chronological_split": _s("SELECT match_id, split FROM split_matches"),
    "split_plan": _m(
        f"""SELECT CASE WHEN {_TIME} <= train_cutoff THEN 'train' WHEN {_TIME} <= validation_cutoff THEN 'validation' ELSE 'test' END AS split,
        {_SUMMARY}, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM matches), 6) AS share FROM matches, cuts GROUP BY 1""",
        _boundaries("matches", _TIME),
    ),
    "split_summary": _s(
        f"""SELECT split, {_SUMMARY}, round(avg(y), 6) AS label_rate,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM matches), 6) AS share FROM split_matches GROUP BY 1"""
    ),
    "split_counts": _s(
        "SELECT n.split, m.matches FROM split_names n LEFT JOIN (SELECT split, count(*) AS matches FROM split_matches GROUP BY 1) m USING (split)"
    ),
    # encoder
    "vocabulary": _p(
        """SELECT 'item' AS kind, hero_id AS value, count(*) AS uses FROM picks WHERE split = 'train' GROUP BY 2
        UNION ALL SELECT 'version', CAST(game_version_id AS BIGINT), count(*) FROM split_matches WHERE split = 'train' GROUP BY 2"""
    ),
    "vocabulary_summary": _v(
        """SELECT 'item' AS kind, CAST(count(*) AS INT) AS size, min(hero_id) AS min_id, max(hero_id) AS max_id FROM known_heroes
        UNION ALL SELECT 'version', CAST(count(*) AS INT), CAST(min(game_version_id) AS BIGINT), CAST(max(game_version_id) AS BIGINT) FROM known_patches"""
    ),
    "known_versions": _v(
        """SELECT split, count(*) FILTER (WHERE known) AS kept, count(*) FILTER (WHERE NOT known) AS nulled FROM (
        SELECT split, game_version_id IN (SELECT game_version_id FROM known_patches) AS known FROM split_matches) GROUP BY 1"""
    ),
    "encoded_long": _e("SELECT match_id, feature, value FROM cells"),
    "encoded_long_by_join": _e("SELECT match_id, feature, value FROM cells"),
    "encoded_long_by_table": _e("SELECT match_id, feature, value FROM cells"),
    "unseen_hero_summary": _v(
        """SELECT n.split, count(u.hero_id) AS unseen_picks, count(DISTINCT u.hero_id) AS unseen_hero_ids,
        count(DISTINCT u.match_id) AS affected_matches FROM split_names n LEFT JOIN unseen u USING (split) GROUP BY 1"""
    ),
    "unseen_hero_catalog": _unseen_catalog(f"{_SIDE_ORDER}, {_TIME}, match_id"),
    "unseen_hero_catalog_by_time": _unseen_catalog(f"{_TIME}, match_id, {_SIDE_ORDER}"),
    "unseen_patch_summary": _v(
        """SELECT n.split, count(u.match_id) AS matches_with_unseen_patch, count(DISTINCT u.game_version_id) AS unseen_patch_ids
        FROM split_names n LEFT JOIN unseen_rows u USING (split) GROUP BY 1"""
    ),
    "unseen_patch_catalog": _v("SELECT DISTINCT split, game_version_id, game_version FROM unseen_rows"),
    "unknown_totals": _e(
        """SELECT split,
        CAST(sum(CASE WHEN feature = 'unknown_radiant_hero_count' THEN value ELSE 0 END) AS BIGINT) AS unknown_radiant_hero_count,
        CAST(sum(CASE WHEN feature = 'unknown_dire_hero_count' THEN value ELSE 0 END) AS BIGINT) AS unknown_dire_hero_count,
        CAST(sum(CASE WHEN feature = 'patch_unknown' THEN value ELSE 0 END) AS BIGINT) AS matches_with_unknown_patch
        FROM cells GROUP BY 1"""
    ),
    "matrix_split_summary": _e(
        """SELECT split, count(*) AS rows, CAST(max(w) AS INT) AS feature_columns, count(radiant_win) AS target_rows,
        round(avg(y), 6) AS label_rate FROM split_matches, width GROUP BY 1"""
    ),
    "sparsity": _e(
        """SELECT rows, nonzero_values, CAST(w AS INT) AS feature_columns, CAST(rows * w AS BIGINT) AS total_values,
        round(CAST(nonzero_values AS DOUBLE) / (rows * w), 6) AS density
        FROM (SELECT count(DISTINCT match_id) AS rows, count(*) AS nonzero_values FROM cells), width"""
    ),
    "split_sparsity": _e(
        """SELECT split, rows, nonzero_values, CAST(w AS INT) AS feature_columns, CAST(rows * w AS BIGINT) AS total_values,
        round(CAST(nonzero_values AS DOUBLE) / (rows * w), 6) AS density
        FROM (SELECT split, count(DISTINCT match_id) AS rows, count(*) AS nonzero_values FROM cells GROUP BY 1), width"""
    ),
    "active_features": _e(
        """SELECT CAST(nonzero AS INT) AS nonzero_feature_columns, count(*) AS matches,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM split_matches), 6) AS share FROM per_row GROUP BY 1""",
        _ROW_FACTS,
    ),
    "feature_manifest": _v(
        """SELECT 'Known heroes' AS feature_family, CAST(count(*) AS INT) AS columns, 'Training hero IDs' AS source,
          '-1, 0, 1' AS "values", 'One column per training hero' AS handling FROM known_heroes
        UNION ALL SELECT 'Unknown Radiant heroes', 1, 'Future Radiant picks', '0 to 5', 'Count in unknown_radiant_hero_count'
        UNION ALL SELECT 'Unknown Dire heroes', 1, 'Future Dire picks', '0 to 5', 'Count in unknown_dire_hero_count'
        UNION ALL SELECT 'Known patches', CAST(count(*) AS INT), 'Training patch IDs', '0 or 1', 'One-hot columns' FROM known_patches
        UNION ALL SELECT 'Unknown patch', 1, 'Future patch IDs', '0 or 1', 'Single patch_unknown flag'"""
    ),
    "feature_checks": _e(
        _STATUS,
        _ROW_FACTS,
        "\nchecks AS ("
        + _PRE_CHECKS.format(forbidden=_FORBIDDEN)
        + """
  UNION ALL SELECT 'All splits share identical feature columns', TRUE
  UNION ALL SELECT 'Split row counts match targets', count(*) = count(radiant_win) FROM split_matches)""",
    ),
    "pre_model_checks": _e(_STATUS, _ROW_FACTS, "\nchecks AS (" + _PRE_CHECKS.format(forbidden=_FORBIDDEN) + ")"),
    # evaluation
    "class_prior": _s("SELECT round(avg(y), 6) AS prior FROM split_matches WHERE split = 'train'"),
    "accuracy": _s(
        "SELECT split, round(avg(CASE WHEN CAST(p >= 0.5 AS INT) = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY 1", _SCORED
    ),
    "log_loss": _s("SELECT split, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM scored GROUP BY 1", _SCORED),
    "roc_auc": _s(f"SELECT split, {_AUC} FROM running GROUP BY 1", _SCORED, _auc_ctes("split")),
    "roc_points": _s(
        """SELECT split, round(p, 6) AS threshold,
          round(CAST(down_neg AS DOUBLE) / sum(neg) OVER (PARTITION BY split), 6) AS fpr,
          round(CAST(down_pos AS DOUBLE) / sum(pos) OVER (PARTITION BY split), 6) AS tpr FROM running
        UNION ALL SELECT DISTINCT split, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM running""",
        _SCORED,
        _auc_ctes("split"),
    ),
    "roc_corners": _s(_corners("split"), _SCORED, _auc_ctes("split")),
    "roc_corners_lines": f"WITH {_LINES},{_auc_ctes('status')} {_corners('status')}",
    "confusion_matrix": _s(_confusion("split"), _SCORED),
    "quality_metrics": _metrics(_DOCS, ""),
    "quality_confusion": f"WITH {_DOCS} {_confusion('')}",
    "line_metrics": _metrics(_LINES, "status"),
    # models
    "prior_metrics": _s(_PRIOR_METRICS),
    "run_split_counts": _s("SELECT split, count(*) AS matches FROM split_matches GROUP BY 1"),
    "run_shape": _e(
        """SELECT (SELECT count(*) FROM split_matches) AS rows, CAST(w AS INT) AS feature_columns,
        CAST((SELECT count(*) FROM known_heroes) AS INT) AS known_items,
        CAST((SELECT count(*) FROM known_patches) AS INT) AS known_versions FROM width"""
    ),
}
