"""The same queries for DuckDB, written from the definitions of the operators."""

from __future__ import annotations

import numpy as np

from ..config import STEPS, Matching

M = Matching()
#: Rows of the table part for which the SQL knows the draws of bootstraps, as the generator's numbers can't be made in SQL.
PRODUCTS_KNOWN = (200, 2000)
#: Vocabulary rows for which it knows the hash functions: what the queries meet on the given tables. A query on another table
#: finds no hashes, so its rows are missing and it cannot pass by chance.
ROWS_KNOWN = (120, 125, 129, 150, 152, 156, 367, 372, 375, 405, 579)


def _clean(x: str) -> str:
    x = rf"regexp_replace({x}, '([0-9])\s*-?\s*(?:-?inches|-?inch|Inches|Inch|\")', '\1inch', 'g')"
    x = rf"regexp_replace({x}, '([0-9]+)-1/8inch', '\1.1inch', 'g')"  # the only fraction of the table
    x = rf"regexp_replace({x}, '([0-9])\s*-?\s*(?:-?hz|-?Hz|HZ|Hertz|hertz)', '\1hz', 'g')"
    x = rf"regexp_replace({x}, '([0-9])\s+lbs', '\1lbs', 'g')"
    return rf"lower(regexp_replace({x}, '([0-9])\s*(?:pounds| lbs)', '\1lbs', 'g'))"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _model_words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({_words(x)}, lambda w: regexp_matches(w, '[0-9][^0-9, ]|[^0-9, ][0-9]') or lower(w) in ('hdtv', 'led', 'lcd', 'smart', 'ledlcd', 'hd'))))"


RAW = """raw as (
  select p_partkey + 1 as product_id, p_name || '/' || p_brand as model_id,
    case p_partkey % 4 when 0 then 'a.com' when 1 then 'b.com' when 2 then 'c.com' else 'shop.a.com' end as shop,
    p_name || ' ' || p_brand || ' ' || p_type || ' ' || spelled || ' ' || usd || more as title,
    list_concat(list_concat(list_concat(
      case when p_partkey % 7 <> 0 then [{'k': 'Brand', 'v': p_brand}] else [] end,
      case when p_partkey % 10 <> 0 then [{'k': 'Screen Size', 'v': spelled}] else [] end),
      [{'k': 'Type', 'v': p_type}, {'k': 'Retail Price', 'v': usd}]),
      case when p_partkey % 3 = 0 then list_transform(range(1, 20), lambda i: {'k': 'Note ' || i, 'v': 'yes'}) else [] end) as features
  from (select *, case p_partkey % 4 when 0 then p_size || '-Inch' when 1 then p_size || '"' when 2 then p_size || ' inches' else p_size || 'inch' end as spelled,
      cast(floor(p_retailprice) as bigint) || 'usd' as usd,
      case when p_partkey % 6 = 0 then ' 120 Hz' when p_partkey % 6 = 1 then ' 60-hertz' when p_partkey % 6 = 2 then ' 25 pounds' when p_partkey % 9 = 3 then ' ' || p_size || '-1/8"' else '' end
        || case when p_partkey % 11 = 0 then ' ' || p_name || '/' || p_brand else '' end as more
    from part)
)"""

PRODUCTS = f"""{RAW}, products as (
  select product_id, model_id, shop, {_clean("title")} as title,
    list_transform(features, lambda f: {{'k': {_clean("f.k")}, 'v': {_clean("f.v")}}}) as features from raw
)"""

#: brand is null where it is not known; title words are those of the title without joining signs and words.
OWN = f"""{PRODUCTS}, own as (
  select *, list_distinct({_words("plain")}) as words, {_model_words("plain")} as model_words,
    list_sort(list_distinct(flatten(list_transform(features, lambda f: {_model_words("f.v")})))) as value_words,
    list_filter(features, lambda f: f.k = 'brand')[1].v as brand, len(features) as n_features,
    flatten(list_transform(list_filter(features, lambda f: contains(f.k, 'screen size') or contains(f.k, 'display size')),
      lambda f: list_transform(regexp_extract_all(f.v, '([0-9]+\\.?[0-9]*)inch', 1), lambda s: cast(s as double)))) as sizes
  from (select *, trim(regexp_replace(regexp_replace(regexp_replace(title, '[&/\\-_,]', ' ', 'g'), '\\b(?:and|or|the)\\b', ' ', 'gi'), '\\s+', ' ', 'g')) as plain from products)
)"""

NO_SHOP = "not (contains(a.shop, b.shop) or contains(b.shop, a.shop))"
NO_BRAND = "not coalesce(a.brand <> b.brand, false)"
LIKE_SIZE = "len(list_filter(a.sizes, lambda x: len(list_filter(b.sizes, lambda y: abs(x - y) < 1)) > 0)) > 0"


def _pairs(where: str) -> str:
    """own as a and b, as pairs."""
    columns = ", ".join(f"{s}.{c} as {c}_{s}" for s in "ab" for c in ("product_id", "shop", "words", "model_words", "value_words", "n_features", "features"))
    return f"{OWN}, pairs as (select {columns}, a.product_id as id_a, b.product_id as id_b from own a join own b on a.product_id < b.product_id where {where})"


FAST = _pairs(f"{LIKE_SIZE} and {NO_SHOP} and {NO_BRAND}")
ALL = _pairs(f"{NO_SHOP} and {NO_BRAND}")

EDIT = "1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))"

TITLE = f"""cosines as (select id_a, id_b, coalesce(len(list_intersect(words_a, words_b)) / nullif(sqrt(len(words_a)) * sqrt(len(words_b)), 0), 0) as cos from pairs),
split as (select product_id, w as word, regexp_replace(w, '[^0-9]', '', 'g') as digits, regexp_replace(w, '[^a-zA-Z]', '', 'g') as letters from (select product_id, unnest(model_words) as w from own)),
crossed as (select id_a, id_b, x.word as wx, y.word as wy, {EDIT.format("x.word", "y.word")} as e, length(x.word) * length(y.word) as weight,
  x.digits <> '' and y.digits <> '' and x.letters <> '' and y.letters <> '' as hybrid,
  try_cast(x.digits as bigint) as nx, try_cast(y.digits as bigint) as ny, length(x.letters) >= 2 and length(y.letters) >= 2 as long,
  case when x.letters <> '' and y.letters <> '' then {EDIT.format("x.letters", "y.letters")} end as le
  from pairs join split x on x.product_id = id_a join split y on y.product_id = id_b),
mixed as (select id_a, id_b, coalesce(sum(e * weight) / nullif(sum(weight), 0), 0) as avg_all,
  coalesce(sum(case when hybrid and nx = ny and le <= {M.eta} then e * weight end) / nullif(sum(case when hybrid and nx = ny and le <= {M.eta} then weight end), 0), 0) as avg_hybrid,
  count(case when hybrid and long and nx <> ny and le >= {M.eta} then 1 end) as clashes, count(case when hybrid and nx = ny and le >= {M.eta} then 1 end) as shared
  from crossed group by id_a, id_b),
titles as (select id_a, id_b, cos, coalesce(avg_all, 0) as avg_all, coalesce(avg_hybrid, 0) as avg_hybrid, coalesce(clashes, 0) as clashes, coalesce(shared, 0) as shared
  from cosines left join mixed using (id_a, id_b)),
scored as (select *, {M.beta} * cos + {1 - M.beta} * avg_all as base from titles),
finals as (select *, case when shared > 0 then {M.delta} * avg_hybrid + {1 - M.delta} * base else base end as final from scored),
alike as (select *, case when cos > {M.alpha} then 1.0 when clashes >= 2 then null when final > {M.least_title} then final end as title_sim from finals)"""


def _distance(pairs: str, fast: bool) -> str:
    rich = f"n_features_a > {M.rich} and n_features_b > {M.rich}" if fast else "false"
    return f"""with {pairs}, {TITLE},
jac as (select id_a, id_b, {rich} as rich, coalesce(len(list_intersect(value_words_a, value_words_b)) / nullif(len(list_distinct(list_concat(value_words_a, value_words_b))), 0), 0) as mw from pairs)
select id_a, id_b, round(1 - case when rich or title_sim is null then mw else {1 - M.mu} * mw + {M.mu} * title_sim end, 6) as dist from alike join jac using (id_a, id_b)"""


WORDS = """title_words as (select w as word, count(*) as n from (select unnest(regexp_extract_all(title, '([a-zA-Z0-9]*([0-9]+[^0-9, ]+)|([^0-9, ]+[0-9]+))[a-zA-Z0-9]*', 1)) as w from products) where w <> '' group by w having count(*) > 1),
number_words as (select w as word, count(*) as n from (select regexp_replace(coalesce(m, ''), '[a-zA-Z]+$', '') as w from (select unnest(regexp_extract_all(f.v, '([0-9]+(?:\\.[0-9]+)?[a-zA-Z]+$)|[0-9]+(?:\\.[0-9]+)?$', 1)) as m from (select unnest(features) as f from products))) group by w having count(*) > 2),
vocabulary as (select row_number() over (order by kind, word) - 1 as row_id, kind, word from (select 0 as kind, word from title_words union all select 1, word from number_words))"""
VOCABULARY = f"{PRODUCTS}, {WORDS}"

HAD = f"""had as (select product_id, 0 as kind, unnest(list_distinct(list_concat({_model_words("title")}, flatten(list_transform(features, lambda f: {_model_words("f.v")}))))) as word from products
  union all select product_id, 1, w from (select product_id, unnest(list_distinct(flatten(list_transform(features, lambda f: list_transform(regexp_extract_all(f.v, '([0-9]+(?:\\.[0-9]+)?[a-zA-Z]+)$', 1), lambda m: regexp_replace(m, '[a-zA-Z]+$', '')))))) as w from products)),
incident as (select p.product_id, coalesce(list_sort(list(row_id) filter (row_id is not null)), []) as rows from products p left join (select product_id, row_id from had join vocabulary using (kind, word)) h using (product_id) group by p.product_id)"""

GOLD = "gold as (select a.product_id as id_a, b.product_id as id_b from products a join products b on a.model_id = b.model_id and a.product_id < b.product_id)"


def _hashes() -> list[tuple[int, int, list[int], list[int]]]:
    """(rows, n, a, b): n hash functions for as many vocabulary rows. Both lists of numbers are drawn from one legacy
    generator seeded with 42, from 0 and from 1 up to ten times the rows, half as many as rows, made even."""
    cases = []
    for rows in ROWS_KNOWN:
        n = rows // 2 + rows // 2 % 2
        draw = np.random.RandomState(42)
        a, b = draw.randint(0, 10 * rows, n).tolist(), draw.randint(1, 10 * rows, n).tolist()
        cases.append((rows, n, a, b))
    return cases


def _hash_cte(cases: list[tuple[int, int, list[int], list[int]]]) -> str:
    """hashes(n, a, b, k) for as many rows as `vocabulary` has."""
    known = ", ".join(f"({rows}, {n}, {a}, {b})" for rows, n, a, b in cases)
    return f"known(rows, n, a, b) as (values {known}), hashes as (select n, unnest(a) as a, unnest(b) as b, unnest(range(n)) as k from known where rows = (select count(*) from vocabulary))"


SIGNED = """hashed as (select product_id, k, coalesce(min((a * r + b) % n), any_value(n)) as v from (select product_id, unnest(case when len(rows) = 0 then [null] else rows end) as r from incident) cross join hashes group by product_id, k),
signed as (select product_id, list(v order by k) as signature from hashed group by product_id)"""


def _banded(steps: tuple[float, ...]) -> str:
    """banded(b, r, product_id, band, part), and which banding (b, r) is nearest to each t, from the definition."""
    ts = ", ".join(f"({t!r}::double)" for t in steps)
    return f"""steps(t) as (values {ts}),
choice as (select t, b, r from (select t, used // r as b, r, row_number() over (partition by t order by abs(pow(1::double / (used // r), 1::double / r) - t), used desc, r) as o
  from steps, (select unnest(range(greatest(n - 29, 4), n + 1)) as used from (select any_value(n) as n from hashes)), (select unnest(range(2, 700)) as r) where used % r = 0 and used // r > 1) where o = 1),
banded as (select b, r, product_id, i as band, signature[i * r + 1 : i * r + r] as part from signed, (select distinct b, r from choice), (select unnest(range(700)) as i) where i < b)"""


def _candidates(steps: tuple[float, ...]) -> str:
    return f"{_banded(steps)}, candidates as (select distinct x.b, x.r, x.product_id as id_a, y.product_id as id_b from banded x join banded y on x.b = y.b and x.r = y.r and x.band = y.band and x.part = y.part and x.product_id < y.product_id)"


CURVES = """counted as (select t, count(c.id_a) as n_predicted, count(g.id_a) as n_shared from choice left join candidates c using (b, r) left join gold g using (id_a, id_b) group by t),
figures as (select *, coalesce(n_shared / nullif(n_predicted, 0), 0) as pq, coalesce(n_shared / (select nullif(count(*), 0) from gold), 0) as pc, (select cast(count(*) as double) from products) as n from counted),
curves as (select t, pc as pair_completeness, pq as pair_quality, coalesce(2 * pq * pc / nullif(pq + pc, 0), 0) as f1_star, n_predicted / (n * (n - 1) / 2) as frac_comparisons, n_predicted from figures)"""
ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("pair_completeness", "pair_quality", "f1_star", "frac_comparisons"))


def _draws(k: int) -> str:
    """drawn(p, pos): positions drawn for bootstrap k and when first, if the table has a known number of rows."""
    rows = []
    for n in PRODUCTS_KNOWN:
        first: dict[int, int] = {}
        for at, p in enumerate(np.random.RandomState(123 + k).randint(0, n, n).tolist()):
            first.setdefault(p, at)
        rows.append(f"({n}, {list(first)}, {list(first.values())})")
    return f"drawn as (select unnest(p) as p, unnest(pos) as pos from (values {', '.join(rows)}) as d(n, p, pos) where n = (select count(*) from part)), placed as (select *, row_number() over (order by product_id) - 1 as p from products)"


AGREEMENT = """sums as (select count(*) as n_predicted, count(g.id_a) as n_shared from candidates c left join gold g using (id_a, id_b)), golds as (select count(*) as n_gold from gold),
figures as (select *, coalesce(n_shared / nullif(n_predicted, 0), 0) as pq, coalesce(n_shared / nullif(n_gold, 0), 0) as pc from sums, golds)"""


def oracles() -> dict[str, str]:
    out = {
        "clean_titles": f"with {PRODUCTS} select product_id, title from products",
        "clean_features": f"with {PRODUCTS} select product_id, f.k as key, f.v as value from (select product_id, unnest(features) as f from products)",
        "title_model_words": f"with {PRODUCTS} select product_id, array_to_string({_model_words('title')}, '|') as words from products",
        "kvp_model_words": f"with {OWN} select product_id, array_to_string(value_words, '|') as words from own",
        "kvp_extended_words": f"with {PRODUCTS} select product_id, array_to_string(list_sort(list_distinct(flatten(list_transform(features, lambda f: list_transform(regexp_extract_all(f.v, '([0-9]+(?:\\.[0-9]+)?[a-zA-Z]+)$', 1), lambda m: regexp_replace(m, '[a-zA-Z]+$', '')))))), '|') as words from products",
        "vocab_regular": f"with {VOCABULARY} select word, n from title_words",
        "vocab_extended": f"with {VOCABULARY} select word, n from number_words",
        "brands": f"with {RAW} select lower(f.v) as brand, count(*) as n from (select unnest(features) as f from raw) where f.k = 'Brand' group by 1",
        "screen_sizes": f"with {OWN} select product_id, unnest(sizes) as size from own",
        "hybrid_split": f"with {OWN} select product_id, word, digits as number, letters from (select product_id, w as word, ltrim(regexp_replace(w, '[^0-9]', '', 'g'), '0') as digits, regexp_replace(w, '[^a-zA-Z]', '', 'g') as letters from (select product_id, unnest(model_words) as w from own)) where digits <> '' and letters <> ''",
        "binary_incidence": f"with {VOCABULARY}, {HAD} select product_id, unnest(rows) as row_id from incident",
        "same_shop_pairs": f"with {_pairs(f'{LIKE_SIZE} and not ({NO_SHOP})')} select id_a, id_b from pairs",
        "diff_brand_pairs": f"with {_pairs(f'{LIKE_SIZE} and not ({NO_BRAND})')} select id_a, id_b from pairs",
        "diff_screen_size_pairs": f"with {_pairs(f'a.brand = b.brand and not ({LIKE_SIZE})')} select id_a, id_b from pairs",
        "size_blocked_pairs": f"with {FAST} select id_a, id_b from pairs",
        "qgram_similarity": f"""with {PRODUCTS}, names as (select distinct split_part(model_id, '/', 1) as name from products),
grams as (select name, list_distinct(list_transform(range(1, length(name) + 3), lambda i: substr('##' || lower(name) || '##', i, 3))) as g from names)
select a.name as name_a, b.name as name_b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) as similarity from grams a join grams b on a.name < b.name""",
        "jaccard_model_words": f"with {FAST} select id_a, id_b, round(coalesce(len(list_intersect(value_words_a, value_words_b)) / nullif(len(list_distinct(list_concat(value_words_a, value_words_b))), 0), 0), 6) as jaccard from pairs",
        "title_cosine": f"with {FAST}, {TITLE} select id_a, id_b, round(cos, 6) as cosine from cosines",
        "model_word_veto": f"with {FAST}, {TITLE} select id_a, id_b, clashes, clashes >= 2 as veto from titles",
        "avg_levenshtein": f"with {FAST}, {TITLE} select id_a, id_b, round(avg_all, 6) as similarity from titles",
        "avg_levenshtein_hybrid": f"with {FAST}, {TITLE} select id_a, id_b, round(avg_hybrid, 6) as similarity from titles",
        "tmwm_similarity": f"with {FAST}, {TITLE} select id_a, id_b, round(coalesce(title_sim, -1), 6) as similarity from alike",
        "msmp_distance": _distance(ALL, False),
        "msmp_fast_distance": _distance(FAST, True),
        "gold_pairs": f"with {PRODUCTS}, {GOLD} select id_a, id_b from gold",
        "dataset_stats": f"""with {RAW}, own as (select *, len(features) as n from raw), models as (select model_id, count(*) as k from raw group by 1)
select (select count(*) from own) as products, (select count(*) from own where not contains(title, model_id)) as without_model_id, (select round(avg(n), 6) from own) as attributes_mean,
(select round(stddev_pop(n), 6) from own) as attributes_std, (select median(n) from own) as attributes_median, (select min(n) from own) as attributes_min, (select max(n) from own) as attributes_max,
(select round(100 * avg(case when n >= 20 then 1.0 else 0.0 end), 6) from own) as rich_percent, (select count(*) from models) as models, (select cast(sum(k * (k - 1) // 2) as bigint) from models) as duplicate_pairs""",
        "shop_counts": f"with {RAW} select shop, count(*) as products from raw group by shop",
        "feature_histogram": f"with {RAW} select len(features) as n_features, count(*) as products from raw group by 1",
        "kvp_matching": f"""with {FAST}, keyed as (select id_a, id_b, x.k as kx, x.v as vx, y.k as ky, y.v as vy from (select id_a, id_b, unnest(features_a) as x, features_b from pairs), unnest(features_b) as u(y)),
grams as (select t, list_distinct(list_transform(range(1, length(t) + 3), lambda i: substr('##' || lower(t) || '##', i, 3))) as g from (select kx as t from keyed union select ky from keyed union select vx from keyed union select vy from keyed)),
keys as (select kx, ky, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) as s from (select distinct kx, ky from keyed) join grams a on a.t = kx join grams b on b.t = ky),
hits as (select id_a, id_b, s, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) as v from keyed join keys using (kx, ky) join grams a on a.t = vx join grams b on b.t = vy where s > 0.3)
select p.id_a, p.id_b, count(s) as matches, round(coalesce(sum(s), 0), 6) as weight, round(coalesce(sum(s * v) / nullif(sum(s), 0), 0), 6) as similarity from pairs p left join hits h on h.id_a = p.id_a and h.id_b = p.id_b group by 1, 2""",
    }
    hashes = _hash_cte(_hashes())
    block = f"{VOCABULARY}, {HAD}, {hashes}, {SIGNED}"
    found = f"{block}, {_candidates((0.5,))}"
    measured = f"with {found}, {GOLD}, {AGREEMENT}"
    gated = "(a.product_id, b.product_id) in (select (id_a, id_b) from candidates)"
    sweep = f"{block}, {GOLD}, {_candidates(STEPS)}, {CURVES}"
    small = f"{PRODUCTS.replace('products as (', 'everything as (')}, products as (select * from everything where product_id <= 200), {WORDS}, {HAD}, {hashes}, {SIGNED}, {GOLD}, {_candidates(tuple(k / 20 for k in range(1, 20)))}, {CURVES}"
    runs = []
    for k in range(3):
        every = PRODUCTS.replace("products as (", "everything as (")
        sample = _draws(k).replace("from products", "from everything")
        gold = GOLD.replace("products", "everything")
        runs.append(f"(with {every}, {sample}, products as (select * exclude (p, pos) from placed join drawn using (p)), {WORDS}, {HAD}, {hashes}, {SIGNED}, {gold}, {_candidates(STEPS)}, {CURVES} select * from curves)")
    means = ", ".join(f"round(avg({c}), 6) as {c}" for c in ("pair_completeness", "pair_quality", "f1_star", "frac_comparisons"))
    out |= {
        "minhash_signatures": f"with {block} select product_id, k as hash, v as value from hashed",
        "lsh_buckets": f"with {block}, {_banded((0.5,))} select band, array_to_string(part, ',') as part, count(*) as members, min(product_id) as first, max(product_id) as last from banded group by band, part having count(*) > 1",
        "lsh_candidates": f"with {found} select id_a, id_b from candidates",
        "pair_quality": f"{measured} select n_shared, n_predicted, round(pq, 6) as pair_quality from figures",
        "pair_completeness": f"{measured} select n_shared, n_gold, round(pc, 6) as pair_completeness from figures",
        "f1_metrics": f"{measured} select round(pq, 6) as precision, round(pc, 6) as recall, round(coalesce(2 * pq * pc / nullif(pq + pc, 0), 0), 6) as f1 from figures",
        "msmp_lsh_gated": _distance(_pairs(f"{NO_SHOP} and {NO_BRAND} and {gated}").replace(PRODUCTS, found, 1), False),
        "msmp_fast_lsh_gated": _distance(_pairs(f"{LIKE_SIZE} and {NO_SHOP} and {NO_BRAND} and {gated}").replace(PRODUCTS, found, 1), True),
        "lsh_sweep": f"with {sweep} select t, n_predicted as pairs from curves",
        "f1_star_sweep": f"with {sweep} select t, {ROUNDED} from curves",
        "lsh_small": f"with {small} select t, {ROUNDED} from curves",
        "lsh_bootstraps": f"select t, {means} from ({' union all '.join(runs)}) group by t",
        "bootstrap_train": f"with {PRODUCTS}, {_draws(0)} select product_id, pos as sample_pos from placed join drawn using (p)",
        "bootstrap_oob": f"with {PRODUCTS}, {_draws(0)} select product_id from placed where p not in (select p from drawn)",
        "restricted_gold": f"with {PRODUCTS}, {GOLD}, {_draws(0)}, sample as (select product_id from placed join drawn using (p)) select id_a, id_b from gold where id_a in (from sample) and id_b in (from sample)",
        "json_round_trip": f"with {PRODUCTS} select product_id, model_id, shop, title, len(features) as n_features from products",
        "gold_round_trip": f"with {PRODUCTS}, {GOLD} select id_a, id_b from gold",
    }
    return out
