"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Fixed values: (kind, pattern, group that is measured, its least length); the first three are the base kinds.
SECRETS = [
    ("assign", """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("login", "[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.-]{1,64}@", 0, 0),
]


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, rank, kind, s, e): the text is cut at the matches, so pieces and matches add up to the places."""
    return f"""select doc_id, {rank} rank, '{kind}' kind, e - length(hit) s, e from (
            select doc_id, unnest(h) hit, unnest(g) part,
                unnest(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + list_sum(list_transform(h[1:i], lambda x: length(x)))))::bigint e
            from (select doc_id, regexp_extract_all(t, '{pattern}') h, regexp_extract_all(t, '{pattern}', {group}) g,
                string_split_regex(t, '{pattern}') gaps from texts)
        ) where length(part) >= {least}"""


ORACLES = {
    "op5_secret_scans": f"""
        with texts as (select doc_id, coalesce(text, '') t from documents),
        found as ({" union all ".join(_matches(rank, *rule) for rank, rule in enumerate(SECRETS))}),
        told as (
            select doc_id, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') b, count(*) filter (kind = 'hex') c,
                string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) base,
                string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) spans
            from found group by doc_id
        )
        select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
            sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from documents left join told using (doc_id)
    """,
    "op7_exact_dedup": f"""
        with keyed as (select doc_id, sha256({LOW}) as text_sha256 from documents)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
        from (
            select doc_id, text_sha256, max(doc_id) over g as keep_id, count(*) over g as group_size
            from keyed window g as (partition by text_sha256)
        )
    """,
}


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, byte by byte and bit by bit."""
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b))"
    letters = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce({letters}, lambda crc, b: {bits}, 4294967295::bigint), 4294967295::bigint)"


def _least(costs: list[str]) -> str:
    """Four costs before the inserts, as a list with them."""
    return f"(select [least(a, 3 + c, 6 + d), least(b, 3 + c, 6 + d), least(c, 3 + d), least(d, 3 + c)] from (select {', '.join(f'{x} {n}' for x, n in zip(costs, 'abcd'))}))"


def _before_row() -> str:
    """Costs before a row (role initial ``r``, ``must`` go, ``mend``) from those after it, ``v``; states count from 1."""
    keeps = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    costs = []
    for state, kept in keeps.items():
        to = max(kept.values()) if state != 3 else 4
        stay = " ".join(f"when r = '{role}' then v[{after}]" for role, after in kept.items())
        costs.append(f"least(4 + v[{state}], case when must then 1000000 else mend + least(3 + v[{to}], case {stay} else 1000000 end) end)")
    return _least(costs)


_NEXT = "[3, 3, 4, 3][st]"
_KEPT = "case when st = 1 and r = 's' then 2 when st in (1, 2, 4) and r = 'u' then 3 when st = 3 and r = 'a' then 4 end"

ORACLES["op11_conversation_repair"] = rf"""
    with recursive hits as (
        select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') t,
            {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 h
        from conversations
    ),
    damaged as (
        select conv_id, turn, case when h = 4 then 'user' else role end as role,
            case h when 1 then '' when 2 then translate(t, '.!?', '') else t end t
        from hits, unnest(case h when 0 then []::int[] when 3 then [1, 2] else [1] end) copies(copy)
    ),
    placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(t)) i, count(*) over (partition by conv_id) n
        from damaged
    ),
    told as (
        select *, left(role, 1) r, lead(left(role, 1)) over (partition by conv_id order by i) following,
            not regexp_matches(t, '[^\x20\x09-\x0D]') blank, row_number() over (partition by conv_id, role, t order by i) > 1 again,
            right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') as open
        from placed
    ),
    rows as (
        select *, blank or again must, not blank and not again and open cut, case when not blank and not again and open then 3 else 0 end mend
        from told
    ),
    back as (
        select conv_id, n + 1 i, {_least(['0', '1000000', '1000000', '0'])} v from rows where i = n
        union all
        select b.conv_id, b.i - 1, {_before_row()} from back b join rows on rows.conv_id = b.conv_id and rows.i = b.i - 1
    ),
    steps as (
        select back.conv_id, back.i, back.v, following.v as after, rows.r, rows.role, rows.t, rows.must, rows.mend
        from back left join rows on rows.conv_id = back.conv_id and rows.i = back.i
        left join back following on following.conv_id = back.conv_id and following.i = back.i + 1
    ),
    walk as (
        select conv_id, 1::bigint i, 1 st, '' audit, []::varchar[] lines from rows where i = 1
        union all
        select conv_id, case when edit = 'I' then i else i + 1 end,
            case edit when 'D' then st when 'K' then {_KEPT} else {_NEXT} end,
            audit || edit,
            case edit when 'D' then lines
                when 'K' then list_append(lines, role || ':' || t)
                else list_append(lines, case {_NEXT} when 3 then 'user' else 'assistant' end || ':' || case edit when 'R' then t else '' end)
            end
        from (
            select walk.*, r, role, t,
                case when r is not null and 4 + after[st] = v[st] then 'D'
                    when 3 + v[{_NEXT}] = v[st] then 'I'
                    when r is not null and not must and mend + after[{_KEPT}] = v[st] then 'K'
                    when r is not null then 'R'
                end edit
            from walk join steps on steps.conv_id = walk.conv_id and steps.i = walk.i
        ) where edit is not null
    ),
    ends as (select conv_id, audit, lines from walk qualify row_number() over (partition by conv_id order by length(audit) desc) = 1),
    faults as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank,
            count(*) filter (again and not blank) duplicate, count(*) filter (cut) truncated,
            count(*) filter (following is not null and r || following not in ('su', 'ua', 'au')) illegal
        from rows group by conv_id
    )
    select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
        coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(v[1], 0)::bigint as cost,
        coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) left join faults using (conv_id) left join ends using (conv_id)
    left join (select conv_id, v from back where i = 1) using (conv_id)
"""
