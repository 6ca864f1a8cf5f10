"""SQL that several twins share: the views, then per-story spectrum and metrics."""

from __future__ import annotations

from ..enums import LEFT, RIGHT
from ..views import AS_OF, BIAS_SQL, SQL

NOW = f"TIMESTAMP '{AS_OF}'"
IN_LEFT, IN_RIGHT = (", ".join(f"'{b}'" for b in x) for x in (LEFT, RIGHT))


def age(since: str, until: str = NOW) -> str:
    return f"(epoch_us({until}) - epoch_us({since})) / 3.6e9"


METRICS = f"""{SQL},
spec AS (SELECT story_id, bias, n, floor(100.0 * n / sum(n) OVER (PARTITION BY story_id) + 0.5)::INT AS pct, list_position({BIAS_SQL}, bias) - 1 AS ord FROM (SELECT story_id, bias, count(*) AS n FROM art GROUP BY ALL)),
side AS (SELECT story_id, coalesce(sum(pct) FILTER (bias IN ({IN_LEFT})), 0) AS l, coalesce(sum(pct) FILTER (bias = 'center'), 0) AS c, coalesce(sum(pct) FILTER (bias IN ({IN_RIGHT})), 0) AS r,
  count(*) FILTER (pct > 0) AS k, sum(CASE WHEN pct > 0 THEN pct END)::DOUBLE AS tot FROM spec GROUP BY story_id),
ent AS (SELECT story_id, CASE WHEN any_value(k) > 1 THEN 0.5 + 0.5 * sum(CASE WHEN pct > 0 THEN -pct / tot * ln(pct / tot) END) / ln(any_value(k)) ELSE 0.5 END AS factor FROM spec JOIN side USING (story_id) GROUP BY story_id),
m0 AS (SELECT story_id, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources, count(DISTINCT ownership) AS source_diversity,
  count(*) FILTER ({age('published_at')} <= 24) AS articles_24h, count(*) FILTER ({age('published_at')} <= 48) AS articles_48h, count(*) FILTER ({age('published_at')} <= 168) AS articles_7d,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE {age('min(published_at)', 'max(published_at)')} END AS coverage_hours FROM art GROUP BY story_id),
met AS (SELECT *, floor(100 * (0.3 * least(n_sources / 20, 1) + 0.3 * least(articles_24h / 10, 1) + 0.2 * least(coverage_hours / 168, 1) + 0.2 * least(source_diversity / 6, 1)) + 0.5)::INT AS impact_score FROM m0),
aud AS (SELECT audience, count(DISTINCT session_id) AS viewers FROM eng WHERE action IN ('view', 'read_through') AND {age('created_at')} <= 6 AND {age('created_at')} >= 0 GROUP BY audience),
tre AS (SELECT story_id, topic, region, s.factuality, headline, first_published, reader_id, impact_score, articles_24h, n_sources, n_articles, k, l, r, factor, coalesce(viewers, 0) AS viewers,
  CASE WHEN impact_score <= 0 THEN 0.0 ELSE impact_score * (1 + log10(greatest(articles_24h, 1))) * factor * pow(greatest({age('first_published')}, 0) + 2, -1.5) * (1 + log10(1 + coalesce(viewers, 0))) END AS score,
  n_sources > 1 AND (l >= 80 OR r >= 80) AS blind
  FROM sto s JOIN met USING (story_id) JOIN side USING (story_id) JOIN ent USING (story_id) LEFT JOIN aud USING (audience) WHERE status = 'published' AND {age('first_published')} <= 168)
"""
