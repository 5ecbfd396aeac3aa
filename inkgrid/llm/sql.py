"""SQL for DuckDB that gives the rows of those corpus queries that SQL can express, from the contracts alone."""

from __future__ import annotations

#: Words of a text, A-Z lower-cased where asked for.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: after each byte is mixed in come eight shifts."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substring({text}, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: case when b >= 0 then xor(c, b) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295)"


URL_RULES = """
with p as (select page_id, url, coalesce(instr(url, '://'), 0) place from pages),
r as (select page_id, case when place > 0 then substring(url, place + 3) else '' end rest from p),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') host, rest from r),
s as (select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substring(rest, length(host) + 1), '^[^?#]*') path0, substring(rest, length(host) + 1) after from h),
t as (select page_id, host, case when starts_with(after, '/') then path0 else '' end path from s),
rules as (select * from (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) v(rule, of_host, of_path, rule_verdict)),
f as (select page_id, host, path, rule, rule_verdict, row_number() over (partition by page_id order by length(rule) desc nulls last) n from t left join rules on (host = of_host or ends_with(host, '.' || of_host)) and starts_with(path, of_path))
select page_id, host, path, rule, rule_verdict from f where n = 1"""

#: Base32 is read off the hex digits, five of them (20 bits) for four characters.
_BASE32 = "list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1], lambda q: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring(d, i + 1, 5))::bigint // q) % 32)::int + 1, 1)), 'string_agg', '')), 'string_agg', '')"

WARC = f"""
with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, strlen(h)::bigint payload_bytes, sha1(h) d from p),
f as (select *, min(page_id) over (partition by d) head from d)
select page_id, payload_bytes, {_BASE32} payload_digest, case when page_id = head then 'response' else 'revisit' end record_type, case when page_id = head then null else head end refers_to from f"""

SUFFIX = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents), n as (select doc_id, h, length(h) // 2 n_bytes from t),
w as (select doc_id, unnest(range(0, n_bytes - 99)) i, h from n where n_bytes >= 100),
s as (select doc_id, i, md5_number(substring(h, 2 * i + 1, 200)) k from w),
e as (select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 again from s),
g as (select doc_id, i, sum(case when i - last > 100 or last is null then 1 else 0 end) over (partition by doc_id order by i) run from (select doc_id, i, lag(i) over (partition by doc_id order by i) last from e where again)),
c as (select doc_id, run, min(i) a, max(i) + 100 b from g group by 1, 2),
k as (select doc_id, count(*) n_spans, sum(b - a) n_removed, list(a order by a) starts, list(b order by a) ends from c group by 1),
r as (select n.doc_id, n.n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, h, list_concat([0::bigint], coalesce(ends, [])) a, list_concat(coalesce(starts, []), [n.n_bytes]) b from n left join k on k.doc_id = n.doc_id)
select doc_id, n_bytes::bigint n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda j: substring(h, 2 * a[j] + 1, 2 * (b[j] - a[j]))), ''))) kept_sha256 from r"""


def language_model(order: int, prior: float, discount: float) -> str:
    """Order 2 or 3, as sums over all n-grams."""
    third = f"case when h2 > 0 then (k3 + {prior!r} * p2) / (h2 + {prior!r}) else p2 end" if order == 3 else "p2"
    return f"""
with d as (select row_number() over () rid, doc_id, {_WORDS.format(_LOWER)} ws from documents), e as (select *, {crc32('cast(doc_id as varchar)')} % 7 = 2 held from d),
u as (select rid, held, unnest(list_concat(['S'], list_transform(ws, lambda w: 'w' || w), ['E'])) w, generate_subscripts(list_concat(['S'], ws, ['E']), 1) i from e),
g as (select *, lag(w, 1) over (partition by rid order by i) a, lag(w, 2) over (partition by rid order by i) b from u),
c1 as (select w, count(*) c from g where not held group by 1), c2 as (select a, w, count(*) c from g where not held and a is not null group by 1, 2), c3 as (select b, a, w, count(*) c from g where not held and b is not null group by 1, 2, 3),
z as (select sum(c)::double n, count(*)::double v from c1 where w <> 'S'),
p as (select rid, coalesce(c1.c, 0) k1, n, v, case when c1.c > 0 then (c1.c - {discount!r}) / n else {discount!r} * v / n end p1, f1.c h1, coalesce(c2.c, 0) k2, f2.c h2, coalesce(c3.c, 0) k3
  from g cross join z left join c1 on c1.w = g.w left join c1 f1 on f1.w = g.a left join c2 on c2.a = g.a and c2.w = g.w left join c2 f2 on f2.a = g.b and f2.w = g.a left join c3 on c3.b = g.b and c3.a = g.a and c3.w = g.w where g.i > 1),
q as (select *, case when h1 > 0 then (k2 + {prior!r} * p1) / (h1 + {prior!r}) else p1 end p2 from p),
s as (select rid, count(*) n_tokens, sum((k1 > 0)::int)::bigint n_known, any_value(n)::bigint train_tokens, round(fsum(log10((k1 + 1) / (n + v + 1))), 6) base_score, round(fsum(log10({third})), 6) score from q group by 1)
select doc_id, held held_out, n_tokens, n_known, train_tokens, base_score, score from e join s on s.rid = e.rid"""


TEXT_COUNTS = rf"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} ws from documents),
w as (select doc_id, i, ws[i:i + 4] win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from d where len(ws) >= 5)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) n from w) where n > 1),
c as (select doc_id, count(distinct i + o)::bigint n from r, (select unnest(range(5)) o) group by 1),
l as (select doc_id, (count(*) - count(distinct x))::bigint n from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(l.n, 0) n_dup_lines, coalesce(c.n, 0) n_repeat_words from d left join l on l.doc_id = d.doc_id left join c on c.doc_id = d.doc_id)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m"""
