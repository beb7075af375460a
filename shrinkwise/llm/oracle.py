"""DuckDB SQL for the registered queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_exact_dedup": f"""
        with n as (select doc_id, {_LOWER} as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from n join g using (t)
    """,
    "op4_substring_dedup": r"""
        with d as materialized (
            select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
        ),
        windows as (
            select r, i, sha256(array_to_string(w[i : i + 34], ' ')) as g
            from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)
        ),
        again as (select r, i from (select r, i, count(*) over (partition by g) as n from windows) where n > 1),
        gone as (select distinct r, unnest(range(i, i + 35)) as p from again),
        words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select r, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (r, p) group by r)
        select doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept using (r)
    """,
    "op10_embedding_pairs": """
        with recursive v as materialized (
            select row_number() over () as r, vec_id, label, embedding::double[] as e, sqrt(list_inner_product(e, e)) as size
            from embeddings where label is not null and embedding is not null
        ),
        good as (select * from v where isfinite(size) and size > 0),
        pairs as materialized (
            select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
            where list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
        ),
        reach(a, b) as (select a, b from pairs union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
        least as (select a, min(b) as b from reach group by a),
        degrees as (select a, count(*) as n from pairs group by a)
        select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least.b, vec_id)) as component_id,
            vec_id <= coalesce(least.b, vec_id) as kept
        from embeddings left join least on vec_id = least.a left join degrees on vec_id = degrees.a
    """,
    "op11_decontamination": f"""
        with d as (select row_number() over () as r, doc_id, {_LETTERS} as w from documents),
        b as (select item_id, {_LETTERS} as w from benchmark),
        b_windows as (
            select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + 9], ' ') as g
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
        ),
        sizes as (select distinct k from b_windows),
        d_windows as (
            select r, k, i, array_to_string(w[i : i + k - 1], ' ') as g
            from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join sizes where len(w) >= k)
        ),
        found as (select r, k, i, item_id from d_windows join b_windows using (k, g)),
        hit as (
            select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, k, i from found)) group by r
        ),
        named as (
            select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
            from (select distinct r, cast(item_id as varchar) as item_id from found where item_id is not null) group by r
        )
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join named using (r)
    """,
    "op13_fill_in_middle": r"""
        with u as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as w,
                sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h
            from documents
        ),
        n as (select *, len(w) as n, [('0x' || substr(h, i, 8))::ubigint for i in [1, 9, 17, 25]] as x from u),
        c as (
            select *, least(x[1] % (n + 1), x[2] % (n + 1))::int as a, greatest(x[1] % (n + 1), x[2] % (n + 1))::int as b,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 100 then 'plain'
                    when x[4] % 100 < 50 then 'spm' else 'psm' end as form
            from n
        ),
        p as (
            select *, array_to_string(w[1 : a], '') as prefix, array_to_string(w[a + 1 : b], '') as middle, array_to_string(w[b + 1 :], '') as suffix from c
        )
        select doc_id, n::bigint as n, form,
            case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(t) as restored_sha256
        from p
    """,
}
