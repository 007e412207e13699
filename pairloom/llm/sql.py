"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def url_verdicts(rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 10) -> str:
    """Verdicts on pages: the longest rule that fits, else the host's trust and distrust after so many rounds."""
    listed = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    host_of = f"coalesce(translate(regexp_extract(substr({{0}}, nullif(strpos({{0}}, '://'), 0) + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')"
    link = """(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*([a-z][a-z0-9+.-]*://[^\\s"''>]+)"""
    steps = [f"now0 as (select host, trust * {1 - damping!r} as trust, distrust * {1 - damping!r} as distrust from seeds)"]
    for k in range(rounds):
        steps.append(f"""now{k + 1} as (select host, sum(trust) as trust, sum(distrust) as distrust from (
  select dst as host, trust * n / n_out * {damping!r} as trust, 0.0 as distrust from edges join now{k} on host = src join outward using (src)
  union all select src, 0.0, distrust * n / n_in * {damping!r} from edges join now{k} on host = dst join inward using (dst)
  union all select host, trust * {1 - damping!r}, distrust * {1 - damping!r} from seeds) group by host)""")
    return f"""with rules(verdict, own, prefix) as (values {listed}),
read as (select row_number() over () as row, page_id, html, {host_of.format("url")} as host,
  coalesce(regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^[^/?#]*([^?#]*)', 1), '') as path from pages),
fits as (select row, max({{'size': length(own || prefix), 'rule': own || prefix, 'verdict': verdict}}) as f from read join rules
  on (host = own or ends_with(host, '.' || own)) and starts_with(path, prefix) group by row),
judged as (select r.*, f.rule as rule, f.verdict as found from read r left join fits using (row)),
counted as (select host, count(*) filter (found = 'allow') as t, count(*) filter (found = 'block') as d from judged where found is not null and host <> '' group by host),
seeds as (select host, coalesce(t / nullif(sum(t) over (), 0), 0) as trust, coalesce(d / nullif(sum(d) over (), 0), 0) as distrust from counted),
links as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as link from read),
ends as (select src, {host_of.format("link")} as dst from links),
edges as (select src, dst, count(*) as n from ends where src <> '' and dst <> '' and src <> dst group by src, dst),
outward as (select src, sum(n) as n_out from edges group by src), inward as (select dst, sum(n) as n_in from edges group by dst),
{", ".join(steps)}
select page_id, j.host, path, rule, coalesce(found, case when distrust > trust then 'block' else 'allow' end) as verdict from judged j left join now{rounds} using (host)"""
