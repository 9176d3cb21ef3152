"""SQL of the number fold and of the English profile, with expected values of its own.

Tokens without a role in the fold end every pending number, so only the runs of tokens between them are
walked, one token per step of a recursive query whose state is (pending number, is it an integer, mark).
"""

from __future__ import annotations

_ONES = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen"
).split()
_ONES_PLURAL = (
    "ones twos threes fours fives sixes sevens eights nines tens elevens twelves thirteens fourteens fifteens sixteens"
    " seventeens eighteens nineteens"
).split()
_ORDINALS = (
    "first second third fourth fifth sixth seventh eighth nineth tenth eleventh twelfth thirteenth fourteenth fifteenth"
    " sixteenth seventeenth eighteenth nineteenth"
).split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_TENS_PLURAL = "twenties thirties forties fifties sixties seventies eighties nineties".split()
_TENTHS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
_POWERS = (
    "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion"
).split()
_BEFORE_HALF = "|".join(["o", "oh", "zero", *_ONES, *_TENS, "hundred", *_POWERS])


def _lexicon() -> str:
    rows = [(w, "zero", "0", "") for w in ("o", "oh", "zero")] + [("zeroth", "small", "0", "th")]
    for n, (plain, plural, ordinal) in enumerate(zip(_ONES, _ONES_PLURAL, _ORDINALS), start=1):
        end = "st" if n == 1 else "nd" if n == 2 else "rd" if n == 3 else "th"
        rows += [(plain, "small", str(n), ""), (plural, "small", str(n), "s"), (ordinal, "small", str(n), end)]
    for n, (plain, plural, ordinal) in enumerate(zip(_TENS, _TENS_PLURAL, _TENTHS), start=2):
        rows += [(plain, "tens", f"{n}0", ""), (plural, "tens", f"{n}0", "s"), (ordinal, "tens", f"{n}0", "th")]
    for zeros, word in [(2, "hundred"), *[(3 * k, w) for k, w in enumerate(_POWERS, start=1)]]:
        rows += [(word + end, "times", "1" + "0" * zeros, end) for end in ("", "s", "th")]
    rows += [("minus", "sign", "-", ""), ("negative", "sign", "-", ""), ("plus", "sign", "+", ""), ("positive", "sign", "+", "")]
    for words, mark in (("pound pounds", "£"), ("euro euros", "€"), ("dollar dollars", "$"), ("cent cents", "¢")):
        rows += [(w, "currency", mark, "") for w in words.split()]
    rows += [("percent", "percent", "%", ""), ("per", "percent", "%", "cent"), ("double", "repeat", "2", "")]
    rows += [("triple", "repeat", "3", ""), ("and", "and", "", ""), ("point", "point", "", "")]
    return ",".join("('" + "','".join(row) + "')" for row in rows)


def fold(source: str, key: str = "id") -> str:
    """CTEs from ``source`` (``key``, ``t``) to ``folded`` (``key``, ``t``); the statement must be recursive."""
    before = rf"""regexp_replace(regexp_replace(t,'(^|\s)({_BEFORE_HALF})\s+and\s+a\s+half\b','\1\2 point five ','g'),'^\s*and\s+a\s+half\b',' ')"""
    before = rf"""regexp_replace(regexp_replace({before},'([a-z])([0-9])','\1 \2','g'),'([0-9])([a-z])','\1 \2','g')"""
    before = rf"""regexp_replace({before},'([0-9])\s+(st|nd|rd|th|s)($|[^\p{{L}}\p{{N}}_])','\1\2\3','g')"""
    after = r"""regexp_replace(regexp_replace(t,'([€£$])([0-9]+) (?:and )?¢([0-9])\b','\1\2.0\3','g'),'([€£$])([0-9]+) (?:and )?¢([0-9]{2})\b','\1\2.\3','g')"""
    after = rf"""regexp_replace(regexp_replace({after},'[€£$]0.0([0-9])\b','¢\1','g'),'[€£$]0.([0-9]{{1,2}})\b','¢\1','g')"""
    after = rf"""regexp_replace({after},'\b1(s?)\b','one\1','g')"""
    return rf"""lexicon(w, role, val, suf) as (values {_lexicon()}),
    tokens as (select {key}, unnest(w) w, generate_subscripts(w, 1) p from (
        select {key}, list_filter(string_split_regex({before}, '\s+'), lambda x: x<>'') w from {source})),
    tagged as (select tokens.*, role, val, suf, regexp_full_match(w,'[-+£€$¢]?[0-9]+([.][0-9]+)?') digits,
        regexp_full_match(w,'[0-9]+([.][0-9]+)?') bare, case when suf<>'' and role<>'percent' then 'suffixed' else role end seen
        from tokens left join lexicon using (w)),
    near as (select *, coalesce(role, case when digits then 'digits' end) r, coalesce(lag(seen) over nearby,'other') prev,
        coalesce(lead(seen) over nearby,'other') nrole, lead(w) over nearby nw, lead(val) over nearby nval,
        coalesce(lead(role is not null or bare) over nearby, false) follows,
        coalesce(lead(role is null or (suf='' and role in ('zero','small','tens'))) over nearby, false) decimal_follows
        from tagged window nearby as (partition by {key} order by p)),
    active as (select *, p - row_number() over (partition by {key} order by p) run from near where r is not null),
    runs as (select {key}, min(p) p, list({{'w':w,'r':r,'val':val,'suf':suf,'prev':prev,'nrole':nrole,'nw':nw,'nval':nval,
        'follows':follows,'decimal_follows':decimal_follows}} order by p) ts from active group by {key}, run),
    walk as (
        select {key}, p, ts, 1::bigint i, null::varchar num, false isint, '' mark, []::varchar[] written from runs
        union all
        select {key}, p, ts, i + step,
            case when r in ('small','tens','times') then case when suf='' then new end
                when r='zero' then shown||'0'
                when r='digits' then case when opened then num||w else digit end
                when r='and' then case when silent then num end
                when r='point' then case when not follows then null when decimal_follows then shown||'.' else num end
                when r='repeat' then case when step=2 then shown||repeat(nval, val::int) end end,
            case when r in ('small','tens','times') then newint when r='digits' then not opened and digit not like '%.%'
                when r in ('zero','repeat') then false when r='point' then isint and not decimal_follows else isint end,
            case when r in ('small','tens','times') then case when suf='' and not cut then mark else '' end
                when r in ('zero') then mark
                when r='digits' then case when opened then mark when w[1] in ('-','+','£','€','$','¢') then w[1] when num is null then mark else '' end
                when r='and' then case when silent then mark else '' end
                when r='point' then case when follows then mark else '' end
                when r='repeat' then case when step=2 then mark else '' end
                when r='sign' then case when follows then val else '' end
                else '' end,
            written || case when r in ('small','tens','times') then
                    case when cut then [mark||num] else [] end || case when suf<>'' then [case when cut then '' else mark end||new||suf] else [] end
                when r='digits' then case when not opened and num is not null then [mark||num] else [] end
                when r='and' then case when silent then [] else plain end
                when r='point' then case when follows then [] else plain end
                when r='repeat' then case when step=2 then [] else plain end
                when r='sign' then case when num is not null then [mark||num] else [] end ||
                    case when follows then [] when num is not null then [w] else [mark||w] end
                when r='currency' then case when num is null then [mark||w] else [val||num] end
                when r='percent' then case when num is null then [mark||w] when suf<>'' and coalesce(nw,'')<>suf then plain else [mark||num||'%'] end
                else []::varchar[] end
        from (select *, case when r='times' then coalesce(product, val) else added end new,
                case when r='times' then true else addedint end newint, r='times' and num is not null and product is null cut
            from (select *, case when isint and num='0' then '' else coalesce(num,'') end shown, try_cast(num as hugeint) n, case when length(num)<=16 then (try_cast(num as decimal(22,4))*10000)::hugeint end units,
                not isint and coalesce(num,'') like '%.' opened, follows and prev='times' silent,
                case when num is not null then [mark||num, w] else [mark||w] end plain,
                case when r='repeat' and nrole in ('zero','small') or r='percent' and num is not null and suf<>'' and coalesce(nw,'')=suf then 2 else 1 end step,
                case when try_cast(ltrim(w,'-+£€$¢') as decimal(38,6))=floor(try_cast(ltrim(w,'-+£€$¢') as decimal(38,6)))
                    then floor(try_cast(ltrim(w,'-+£€$¢') as decimal(38,6)))::hugeint::varchar else ltrim(w,'-+£€$¢') end digit,
                num is null or (isint and prev<>'small' and try_cast(num as hugeint) % (case when length(val)<2 then 10 else 100 end)=0) addedint,
                case when num is null then val when not isint and length(val)<2 and prev='tens' then substring(num,1,length(num)-1)||val
                    when addedint then (try_cast(num as hugeint)+try_cast(val as hugeint))::varchar else num||val end added,
                case when isint then ((n//1000)*1000+(n%1000)*try_cast(val as hugeint))::varchar
                    when units=0 then '0' when length(val)>=5 then units::varchar||repeat('0', (length(val)-5)::int)
                    when units*try_cast(val as int)%10000=0 then (units*try_cast(val as int)//10000)::varchar end product
                from (select {key}, p, ts, i, num, isint, mark, written, unnest(ts[i]) from walk where i<=len(ts)))) s),
    pieces as (select {key}, p, w t from near where r is null union all
        select {key}, p, array_to_string(written || case when num is null then [] else [mark||num] end, ' ') from walk where i>len(ts)),
    joined as (select {key}, string_agg(t, ' ' order by p) t from pieces where t<>'' group by {key}),
    folded as (select s.{key}, coalesce({after.replace('(t,', '(joined.t,')}, '') t from {source} s left join joined using ({key}))"""
