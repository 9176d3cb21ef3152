"""The registered queries in SQL, for an engine that shares no code with Spark.

Error counts are not recomputed by a table here; whole documents would make that quadratic.  They
are known by proof instead.  Let a reference of n words lose d words and have s words replaced by a
mark that occurs in no reference.  The hypothesis has n - d words, of which n - d - s can match
anything, and every reference word without a match costs at least one edit, so the distance is at
least n - (n - d - s) = d + s, which the damage itself attains.  With i marks inserted and nothing
lost, n + i words hold at most n matches, so the distance is exactly i.
"""

from __future__ import annotations

from uttermark.plans import number_sql
from uttermark.plans.catalogue import DICTIONARY, PHRASES

W = r"\p{L}\p{N}_"


# Fixed values, written out once more: what the rules, code tables and prompts of the product have to be.
FILLERS = "hmm mm mhm mmm uh um"
RULES = """won't=will not
can't=can not
let's=let us
ain't=aint
y'all=you all
wanna=want to
gotta=got to
gonna=going to
i'ma=i am going to
imma=i am going to
woulda=would have
coulda=could have
shoulda=should have
ma'am=madam"""
TITLES = """mr=mister 
mrs=missus 
st=saint 
dr=doctor 
prof=professor 
capt=captain 
gov=governor 
ald=alderman 
gen=general 
sen=senator 
rep=representative 
pres=president 
rev=reverend 
hon=honorable 
asst=assistant 
assoc=associate 
lt=lieutenant 
col=colonel 
jr=junior 
sr=senior 
esq=esquire """
ENDINGS = """'d been= had been
's been= has been
'd gone= had gone
's gone= has gone
'd done= had done
's got= has got
n't= not
're= are
's= is
'd= would
'll= will
't= not
've= have
'm= am"""
LANGUAGE_CODES = "en=eng_Latn de=deu_Latn fr=fra_Latn es=spa_Latn it=ita_Latn pt=por_Latn nl=nld_Latn pl=pol_Latn cs=ces_Latn da=dan_Latn el=ell_Grek et=est_Latn fi=fin_Latn hr=hrv_Latn hu=hun_Latn lt=lit_Latn lv=lvs_Latn mt=mlt_Latn ro=ron_Latn ru=rus_Cyrl sk=slk_Latn sl=slv_Latn sv=swe_Latn uk=ukr_Cyrl"
WHISPER_UNSUPPORTED = "ast_Latn ceb_Latn ckb_Arab fuv_Latn gle_Latn ibo_Latn kam_Latn kea_Latn kir_Cyrl lug_Latn luo_Latn nso_Latn tgl_Latn umb_Latn wol_Latn xho_Latn zul_Latn"
SEAMLESS_UNSUPPORTED = "ast_Latn hau_Latn kam_Latn kea_Latn lin_Latn mri_Latn nso_Latn oci_Latn tgl_Latn umb_Latn wol_Latn xho_Latn"
RUNS_PLANNED = "ami:test earnings22:test gigaspeech:test librispeech:test.clean librispeech:test.other spgispeech:test tedlium:test voxpopuli:test earnings21:test earnings22:test tedlium:test ATL:test DCA:test DCB:test DTA:test LES:test PRV:test ROC:test VLD:test"
MULTILINGUAL_RUNS = "fleurs_de:test fleurs_fr:test fleurs_it:test fleurs_es:test fleurs_pt:test mcv_de:test mcv_es:test mcv_fr:test mcv_it:test mls_es:test mls_fr:test mls_it:test mls_pt:test"
INSTRUCTION = (
    'Listen to the audio passage, then answer the following question by responding with ONLY the number ('
    '1, 2, 3, or 4) of the correct answer.'
)


def _rules(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split("=")) for line in text.split("\n")]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(text: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({text}),'[<\[][^>\]]*[>\]]','','g'),'\(([^)]+?)\)','','g')"


def _plain(text: str) -> str:
    """Diacritics removed, special letters spelled out, symbols to spaces."""
    for letter, spelling in {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l"}.items():
        text = f"replace({text},'{letter}','{spelling}')"
    return rf"regexp_replace(strip_accents({text}),'[\p{{M}}\p{{S}}\p{{P}}]',' ','g')"


def _collapse(text: str) -> str:
    return rf"regexp_replace({text},'[\s\p{{Z}}]+',' ','g')"


def _multilingual(text: str) -> str:
    return rf"trim({_collapse(rf'''regexp_replace({_plain(_spans(text))},'[^{W}\s\p{{Z}}]','','g')''')})"


REFERENCES = f"""refs as (select doc_id, lang, source, n_chars, s, string_split(s, ' ') w from (
    select doc_id, lang, source, n_chars, {_multilingual('text')} s from documents) where s <> '')"""


def _damage(words: str, drop: str, mark: str) -> str:
    """Number of damaged positions: the proven distance."""
    return (
        f"len(list_filter(range(0, len({words})), lambda i: (i + doc_id) % ({drop}) = 3 or (i + doc_id) % ({mark}) = 2))"
    )


RUNS = f"""{REFERENCES},
runs as (select doc_id, lang, ['org/model-a','org/model-b','org/model-c'][m+1] model_id, 'docs_'||lang dataset,
    case when doc_id%2=0 then 'test.clean' else 'test.other' end split, s "text",
    array_to_string(list_filter(list_transform(w, lambda x, i: case when (i-1+doc_id)%(11+2*m)=3 then null
        when (i-1+doc_id)%(7+m)=2 then '_' else x end), lambda x: x is not null), ' ') pred_text,
    {_damage('w', '11+2*m', '7+m')} errs, len(w) words, n_chars/15.0::double duration,
    case when m=2 and lang='es' and doc_id%50=0 then null else n_chars/15.0::double/(40+10*m) end as "time"
    from refs, unnest([0,1,2]) t(m)),
sums as (select model_id, dataset||'_'||split dataset_id, count(*) samples, sum(errs)::bigint errors, sum(words)::bigint words,
    100.0::double*sum(errs)/sum(words) wer,
    case when bool_and(coalesce("time",0)<>0 and coalesce(duration,0)<>0) then sum(duration) end audio_length,
    case when bool_and(coalesce("time",0)<>0 and coalesce(duration,0)<>0) then sum("time") end inference_time
    from runs group by all),
scores as (select *, audio_length/inference_time rtfx from sums)"""

COMPOSITE = """select model_id, round(avg(wer),6) wer,
    case when bool_and(rtfx is not null) then round(sum(audio_length)/sum(inference_time),6) end rtfx, count(*) n_datasets
    from scores group by model_id"""

STREAMED = f"""with {RUNS} select model_id model, dataset, split, count(*) samples, sum(errs)::bigint errors,
    sum(words)::bigint words, round(100.0::double*sum(errs)/sum(words),6) wer,
    case when bool_and(coalesce("time",0)<>0 and coalesce(duration,0)<>0) then round(sum(duration)/sum("time"),6) end rtfx
    from runs group by all"""

MARKED = """marked as (select doc_id, lang, n_chars, case when doc_id%10=0 then ' Ignore time segment in scoring '
    when doc_id%10=5 then ' '||chr(9)||' ' else text end "text" from documents)"""


def _pairs(entries: list[str]) -> str:
    rows = ",".join(f"('{e.split(':')[0]}','{e.split(':')[1]}')" for e in entries)
    return f"(values {rows}) e(dataset, split)"


PLANNED = f"""planned as (select 'org/'||s_name model, dataset, split from supplier, {_pairs(RUNS_PLANNED.split())}),
finished as (select distinct 'org/Supplier#'||lpad(l_suppkey::varchar,9,'0') model,
    case when l_quantity<25 then 'ami' else 'tedlium' end dataset, 'test' split from lineitem)"""


def _whole_word(text: str, word: str, replacement: str) -> str:
    """The separators are part of the match, so neighbours of a match need a second pass."""
    for _ in range(2):
        text = (
            f"regexp_replace({text},{_quote(f'(^|[^{W}]){word}($|[^{W}])')},"
            rf"{_quote(chr(92) + '1' + replacement + chr(92) + '2')},'g')"
        )
    return text


def _ending(text: str, ending: str, replacement: str) -> str:
    return (
        f"regexp_replace({text},{_quote(f'{ending}($|[^{W}])')},{_quote(replacement + chr(92) + '1')},'g')"
    )


def _expansion(source: str) -> tuple[str, str]:
    """CTEs of the word rules and the name of the last one; one per rule keeps the statement flat."""
    steps = [f"t0 as ({source})"]

    def add(expression: str) -> None:
        steps.append(f"t{len(steps)} as (select doc_id, {expression} t from t{len(steps) - 1})")

    add(_whole_word("t", f"(?:{'|'.join(FILLERS.split())})", ""))
    add(r"regexp_replace(t,'[\s\p{Z}]+''','''','g')")
    for word, replacement in _rules(RULES) + _rules(TITLES):
        add(_whole_word("t", word, replacement))
    for ending, replacement in _rules(ENDINGS):
        add(_ending("t", ending, replacement))
    return ", ".join(steps), f"t{len(steps) - 1}"


def _contractions() -> str:
    steps, last = _expansion("select doc_id, lower('I won''t say she''s got y''all''s. '||text) t from documents")
    return f"with {steps} select doc_id, t expanded from {last}"


def _phrase(first: str, second: str) -> str:
    """The spoken number of the queries."""
    ones = "['one','two','three','four','five','six','seven','eight','nine']"
    tens = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"
    phrase = f"[{','.join(_quote(p) for p in PHRASES)}][({first}+5*({second}))%{len(PHRASES)}+1]"
    for mark, words, at in (("{a}", ones, first), ("{b}", ones, f"{second}+4"), ("{t}", tens, f"{first}+{second}")):
        phrase = f"replace({phrase},'{mark}',{words}[({at})%len({words})+1])"
    return phrase


SAID = f"""said as (select doc_id, lang, text||' Um, she''s got Mr Grey''s ACME™ №7 at 3℃ for 1,250.50 and ½. He won''t. '||
    {_phrase('doc_id', '(doc_id//24)')} "text" from documents)"""


def _decomposed(text: str) -> str:
    """The signs that fall apart into letters and digits, which keep their case in the English profile."""
    for sign, parts in (("™", "TM"), ("№", "No"), ("℃", "°C"), ("½", "1⁄2")):
        text = f"replace({text},'{sign}','{parts}')"
    return text


def _english(rows: str) -> str:
    """CTEs of the whole English profile, the last one ``normal`` (``doc_id``, ``t``)."""
    steps, last = _expansion(f"select doc_id, {_spans('text')} t from {rows}")
    digits = rf"regexp_replace(regexp_replace(t,'(\p{{Nd}}),(\p{{Nd}})','\1\2','g'),'\.([^0-9]|$)',' \1','g')"
    letters = "strip_accents(t)"
    for letter, spelling in {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l"}.items():
        letters = f"replace({letters},'{letter}','{spelling}')"
    # All marks, symbols and punctuation but . % $ and the currency signs, which are set aside as private characters.
    kept = dict(zip(".%$¢€£", "\ue010\ue011\ue012\ue013\ue014\ue015"))
    aside = f"translate({_decomposed(letters)},'{''.join(kept)}','{''.join(kept.values())}')"
    clean = rf"translate(regexp_replace({aside},'[\p{{M}}\p{{S}}\p{{P}}]',' ','g'),'{''.join(kept.values())}','{''.join(kept)}')"
    spelled = "map(['centre','grey','colour'],['center','gray','color'])"
    return rf"""{steps}, digits as (select doc_id, {digits} t from {last}), clean as (select doc_id, {clean} t from digits),
    {number_sql.fold('clean', 'doc_id')},
    spelled as (select doc_id, array_to_string(list_transform(string_split(t,' '), lambda x: coalesce({spelled}[x], x)),' ') t from folded),
    normal as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t,'[.$¢€£]([^0-9])',' \1','g'),'([^0-9])%','\1 ','g'),' {{2,}}',' ','g') t
        from spelled)"""


def _weighted(signal: str) -> str:
    return f"coalesce(round(list_sum(list_transform({signal}, lambda x, i: x::double*i)),4),0) weighted"


def _language_set(codes: list[str]) -> str:
    return ",".join(f"'{c}'" for c in codes)


RECORDINGS = f"""vecs as (select vec_id//12 record, (vec_id%12)//3 part, vec_id%3 k, list_concat(embedding, list_reverse(embedding)[1:vec_id%49]) e,
    abs(embedding[1]::double) whisper, abs(embedding[2]::double) seamless,
    ['eng_Latn','xho_Latn','hau_Latn','zul_Latn'][(vec_id//12)%4+1] lang from embeddings),
judged as (select *, 453-part sid, case when lang in ({_language_set(WHISPER_UNSUPPORTED.split())}) then seamless
    when lang in ({_language_set(SEAMLESS_UNSUPPORTED.split())}) then whisper else (whisper+seamless)/2 end cer from vecs),
takes as (select *, row_number() over (partition by record, part order by k) pos from judged)"""


def _chosen(direction: str) -> str:
    return f"""with {RECORDINGS}, best as (select *, row_number() over (partition by record, part order by cer {direction}, k) rn from takes)
    select record, (row_number() over (partition by record order by sid)-1)::int rank, sid::int sentence_id, pos::int "position" from best where rn=1"""


CHUNKS = """docs as (select doc_id, text, length(text) len from documents),
starts as (select doc_id, text, len, unnest(case when len>300 then range(0,len,200) else [0] end) st from docs),
chunks as (select doc_id, (st//200)::int chunk_idx, substring(text, st+1, case when len>300 then 250 else 300 end) chunk_text from starts),
neighbours as (select *, lag(chunk_text) over (partition by doc_id order by chunk_idx) prev from chunks),
pieces as (select doc_id, chunk_idx, chunk_text, coalesce(list_max(list_filter(range(1, least(length(prev),length(chunk_text))+1),
    lambda n: right(prev,n)=left(chunk_text,n))),0)::int overlap from neighbours)"""

BUCKETS = """with recursive docs as (select doc_id, n_chars, ((row_number() over (order by doc_id)-1)//256)::bigint batch_id from documents),
ranked as (select *, row_number() over (partition by batch_id order by n_chars, doc_id) rn from docs),
walk as (select batch_id, doc_id, n_chars, rn, 0 bucket_id, 1 held from ranked where rn=1
  union all
  select r.batch_id, r.doc_id, r.n_chars, r.rn,
    case when r.n_chars*(w.held+1)>=60000 then w.bucket_id+1 else w.bucket_id end,
    case when r.n_chars*(w.held+1)>=60000 then 1 else w.held+1 end
  from walk w join ranked r on r.batch_id=w.batch_id and r.rn=w.rn+1)
select batch_id, doc_id, n_chars, bucket_id::int bucket_id from walk"""


def _limited(stage: str, n: int = 100) -> str:
    first = "(select * from marked order by doc_id limit 100)" if stage == "before" else "marked"
    last = f" order by doc_id limit {n}" if stage == "after" else ""
    return f"""with {MARKED}, n as (select doc_id, lang, {_multilingual('"text"')} norm_text from {first})
    select doc_id, lang, norm_text from n where trim(norm_text) not in ('', 'ignore time segment in scoring'){last}"""


def _rewrite() -> str:
    keys = ",".join(_quote(k) for k in DICTIONARY)
    values = ",".join(_quote(v) for v in DICTIONARY.values())
    return f"""with n as (select doc_id, string_split({_multilingual('text')}, ' ') w from documents),
    d as (select doc_id, w, map([{keys}],[{values}]) m from n)
    select doc_id, array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ' ') rewritten from d"""


# Every pair of neighbouring turns by the textbook table, one row of it per step.  The last step along a row,
# min(row[j], row[j-1]+1), is a running minimum of row[j]-j.
NEIGHBOURS = f"""with recursive t as (select conv_id, turn, {_multilingual('text')} s from conversations),
    p as (select a.conv_id, a.turn, case when a.s='' then []::varchar[] else string_split(a.s,' ') end r,
        case when b.s='' then []::varchar[] else string_split(b.s,' ') end h from t a join t b on a.conv_id=b.conv_id and b.turn=a.turn+1),
    d as (select conv_id, turn, r, h, 0::bigint i, range(0,len(h)+1) c from p union all
        select conv_id, turn, r, h, i+1, list_transform(range(1,len(h)+2), lambda j: list_min(m[1:j])+j) from (
            select *, list_transform(range(1,len(h)+2), lambda j: case when j=1 then i+1
                else least(c[j]+1, c[j-1]+(r[i+1]<>h[j-1])::bigint) end - j) m from d where i<len(r)))
    select conv_id, turn, c[len(h)+1]::int errs, len(r)::int words from d where i=len(r)"""


# The same pairs by anti-diagonals, each of which needs the two before it.  A cell is errors * 2^40 + substitutions * 2^20 +
# deletions; equal last words are a hit, else the cheapest of substitution, deletion and insertion counts, the first of equals.
KINDS = f"""with recursive t as (select conv_id, turn, {_multilingual('text')} s from conversations),
    p as (select a.conv_id, a.turn, case when a.s='' then []::varchar[] else string_split(a.s,' ') end r,
        case when b.s='' then []::varchar[] else string_split(b.s,' ') end h from t a join t b on a.conv_id=b.conv_id and b.turn=a.turn+1),
    d as (select conv_id, turn, r, h, 0::bigint d, [0::bigint] c, []::bigint[] b from p union all
        select conv_id, turn, r, h, d+1, list_transform(range(0, least(d+1, len(r))+1), lambda i: case
            when d+1-i > len(h) then null when i = 0 then (d+1) * 1099511627776 when i = d+1 then i * 1099511627777
            when r[i] = h[d+1-i] then b[i]
            when b[i] >> 40 <= c[i] >> 40 and b[i] >> 40 <= c[i+1] >> 40 then b[i] + 1099512676352
            when c[i] >> 40 <= c[i+1] >> 40 then c[i] + 1099511627777 else c[i+1] + 1099511627776 end), c
        from d where d < len(r) + len(h)),
    e as (select conv_id, turn, len(r) n, c[len(r)+1] x from d where d = len(r) + len(h)),
    k as (select conv_id, turn, n, (x >> 40)::int errs, ((x >> 20) & 1048575)::int subs, (x & 1048575)::int dels from e)
    select conv_id, turn, errs, n::int words, (n-subs-dels)::int hits, subs substitutions, dels deletions, errs-subs-dels insertions from k"""


def _families() -> str:
    """The British words of the query in order, and what each becomes."""
    given = (
        "colour labouring honourable favourite neighbourhoods humourless organisation realised analysing theatres catalogue"
        " cancelled traveller defences greyer armoury"
    )
    wanted = (
        "color laboring honorable favorite neighborhoods humorless organization realized analyzing theaters catalog"
        " canceled traveler defenses grayer armoury"
    )
    # "centre" is also a word of the documents.
    lists = [",".join(_quote(w) for w in words.split()) for words in (given + " centre", wanted + " center")]
    return f"""with n as (select doc_id, string_split({_multilingual('text')}||' '||[{lists[0]}][doc_id%16+1], ' ') w from documents),
        d as (select doc_id, w, map([{lists[0]}],[{lists[1]}]) m from n)
        select doc_id, ltrim(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ' ')) rewritten from d"""


def _batch_sizes(size: int) -> str:
    return f"""with n as (select l_orderkey, l_linenumber, l_suppkey, l_suppkey%4 lane,
        (row_number() over (partition by l_suppkey%4 order by l_orderkey, l_linenumber, l_suppkey)-1)//{size} b from lineitem)
        select l_orderkey, l_linenumber, l_suppkey, (count(*) over (partition by lane, b))::int batch_rows from n"""


_codes = " ".join("when '{}' then '{}'".format(*pair.split("=")) for pair in LANGUAGE_CODES.split())
_languages = MULTILINGUAL_RUNS.split()
_prompt_tail = _quote(INSTRUCTION)

PAGED = """select html "text", round(length(html)/15.0::double,6) audio_length_s, url src from pages"""

ORACLES: dict[str, str] = {
    "wer_with_losses": f"""with {RUNS} select model_id, dataset_id, count(*) samples, count(*) filter (doc_id%13=0) lost, sum(e)::bigint errors,
        sum(words)::bigint words, round(100.0::double*sum(e)/sum(words),6) wer
        from (select *, dataset||'_'||split dataset_id, case when doc_id%13=0 then words else errs end e from runs) group by 1,2""",
    "wer_of_neighbours": NEIGHBOURS,
    "wer_kinds": KINDS,
    # Marks match nothing, so every error is of the kind of its damage: see the proof above.
    "wer_kinds_by_dataset": f"""with {REFERENCES}, k as (select doc_id, lang, len(w) n, m, doc_id%11=0 lost,
            len(list_filter(range(0,len(w)), lambda i: (i+doc_id)%(11+2*m)=3)) drops,
            len(list_filter(range(0,len(w)), lambda i: (i+doc_id)%(11+2*m)<>3 and (i+doc_id)%(7+m)=2)) marks from refs, unnest([0,1,2]) t(m)),
        s as (select ['org/model-a','org/model-b','org/model-c'][m+1] model_id, 'docs_'||lang||case when doc_id%2=0 then '_test.clean' else '_test.other' end dataset_id,
            sum(n)::bigint words, sum(case when lost then 0 else marks end)::bigint substitutions, sum(case when lost then n else drops end)::bigint deletions from k group by all)
        select model_id, dataset_id, substitutions+deletions errors, words, words-substitutions-deletions hits, substitutions, deletions, 0::bigint insertions,
            round(100.0::double*substitutions/words,6) substitution_rate, round(100.0::double*deletions/words,6) deletion_rate, 0.0::double insertion_rate from s""",
    "discover_results": """with f as (select case when doc_id%2=0 then 'org/big' else 'org/big-v2' end model_id, 'docs_'||lang||'_test.clean' dataset_id,
        length(text)+1 l from documents), s(scope) as (values ('all'),('one'),('like'))
        select scope, model_id, dataset_id, count(*) n, sum(l)::bigint letters from f, s where scope<>'one' or model_id='org/big' group by all""",
    "text_column_extended": f"select conv_id, turn, text original_text, {_multilingual('text')} norm_text from conversations",
    "audio_column_resolution": f"select vec_id, {_weighted('embedding')} from embeddings",
    "short_split": f"""select vec_id, (vec_id%60)::double duration, {_weighted('embedding')} from embeddings where vec_id%3<>0 and vec_id%60<=30""",
    "spelling_families": _families(),
    "wer_by_lang": f"""with {REFERENCES} select lang, sum({_damage('w', '11', '7')})::bigint errors, sum(len(w))::bigint words,
        round(100.0::double*sum({_damage('w', '11', '7')})/sum(len(w)),6) wer from refs group by lang""",
    "wer_insertions_by_source": f"""with {REFERENCES} select source,
        sum(len(list_filter(range(0,len(w)), lambda i: (i+doc_id)%9=4)))::bigint errors, sum(len(w))::bigint words from refs group by source""",
    "cer_by_lang": f"""with {REFERENCES}, c as (select doc_id, lang, range(0, length(replace(s,' ',''))) w from refs)
        select lang, sum({_damage('w', '11', '7')})::bigint errors, sum(len(w))::bigint chars,
        round(100.0::double*sum({_damage('w', '11', '7')})/sum(len(w)),6) cer from c group by lang""",
    "wer_by_model_dataset": f"with {RUNS} select model_id, dataset_id, samples, errors, words, round(wer,6) wer from scores",
    "wer_percent": f"with {RUNS} select model_id, round(100.0::double*sum(errs)/sum(words),2) wer from runs group by 1",
    "rtfx_by_dataset": """select source||'_'||lang dataset_id, round(sum(n_chars/15.0::double),6) audio_length,
        round(sum(n_chars/(300.0::double+doc_id%7)),6) inference_time,
        round(sum(n_chars/15.0::double)/sum(n_chars/(300.0::double+doc_id%7)),6) rtfx from documents group by 1""",
    "rtfx_gate_nulls": """with r as (select user_id%40 run, "value" duration, case when event_id%97=0 then null
        when event_id%89=0 then 0 else "value"/8 end t from events)
        select run, count(*) samples, case when bool_and(coalesce(t,0)<>0 and coalesce(duration,0)<>0)
        then round(sum(duration)/sum(t),6) end rtfx from r group by run""",
    "leaderboard_composite": f"with {RUNS} {COMPOSITE}",
    "leaderboard_composite_rounded": f"with {RUNS} select model_id, round(avg(round(wer,2)),6) wer, count(*) n_datasets from scores group by 1",
    "leaderboard_report": f"""with {RUNS}, c as ({COMPOSITE})
        select 'dataset' as level, model_id, dataset_id, round(wer,6) wer, round(rtfx,6) rtfx, 1::bigint n_datasets from scores
        union all select 'composite', model_id, null, wer, rtfx, n_datasets from c""",
    "accuracy_mcq": """with p as (select role, coalesce(try_cast(nullif(translate(regexp_extract(text,'[1-4A-D]'),'ABCD','1234'),'') as int),-1) p,
        turn%4+1 r from conversations) select role, count(*) total, sum((p=r)::int)::bigint correct,
        coalesce(round(100.0::double*avg((p=r)::int),2),0) accuracy from p group by role""",
    "length_stats": """select lang, source, count(*) n, round(avg(n_chars/15.0::double),6) mean,
        round(coalesce(stddev_samp(n_chars/15.0::double),0),6) std, round(min(n_chars/15.0::double),6) "min",
        round(max(n_chars/15.0::double),6) "max" from documents group by 1,2""",
    "manifest_roundtrip": f"""with {RUNS} select replace(model_id,'/','-') model, dataset, split,
        'sample_'||(row_number() over (partition by model_id,dataset,split order by doc_id)-1) audio_filepath,
        round(duration,6) duration, round("time",6) as "time", "text", pred_text from runs""",
    "sample_index": "select doc_id, lang, (row_number() over (partition by lang order by doc_id)-1)::bigint sample_idx from documents",
    "sample_index_by_text_key": """with r as (select case when event_id%10=0 then 'small' else 'hot' end run, 'utt-'||event_id utterance from events)
        select run, utterance, (row_number() over (partition by run order by utterance)-1)::bigint sample_idx from r""",
    "manifest_identity": """with f as (select doc_id, 'org/model-'||source model_id, 'corpus-docs_'||lang||'_'||
        case doc_id%3 when 0 then 'test.clean' when 1 then 'validation' else 'test' end d from documents)
        select doc_id, model_id, d exact_dataset_id, rtrim(d||'.jsonl','.jsonl') dataset_id from f""",
    "align_inner": "select l.doc_id, quality, lang, n_chars from labels l join documents d on l.doc_id=d.doc_id",
    "align_missing_refs": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "align_missing_hyps": "select c_custkey k, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='P')",
    "align_duplicates": "select l_orderkey, l_suppkey, count(*) n from lineitem group by 1,2 having count(*)>1",
    "matrix_plan": f"with {PLANNED} select * from planned",
    "matrix_plan_languages": f"select 'org/'||s_name model, dataset, split from supplier, {_pairs(_languages)}",
    "matrix_missing": f"with {PLANNED} select p.* from planned p anti join finished f using (model, dataset, split)",
    "matrix_present": f"with {PLANNED} select p.* from planned p semi join finished f using (model, dataset, split)",
    "language_codes": f"""select coalesce(case (case when doc_id%5=0 then source else lang end) {_codes} end,'eng_Latn') code,
        count(*) n from documents group by 1""",
    "scorable_filter": f"""with {MARKED} select doc_id, lang from marked
        where regexp_replace(lower("text"),'^\\s+|\\s+$','','g') not in ('','ignore time segment in scoring')""",
    "repeat_filter": """with c as (select doc_id, string_split(text,'') c from documents)
        select doc_id from c where len(list_filter(range(3,len(c)+1), lambda i: c[i]=c[i-1] and c[i]=c[i-2] and c[i]<>chr(10)))=0""",
    "cjk_filter": "select doc_id from documents where doc_id%4=0 or regexp_matches(text,'[一-鿿]')",
    "length_range": "select doc_id, n_chars from documents where n_chars>450 and n_chars<4500",
    "duration_cap": "select doc_id, round(n_chars/15.0::double,6) duration from documents where doc_id%9<>0 and n_chars/15.0::double<=30",
    "computed_length_cap": """select vec_id, round(len(embedding)::double/(label+1),6) as "seconds" from embeddings
        where len(embedding)::double/(label+1)<=10""",
    "duration_fallback": """select vec_id, coalesce(case when vec_id%3=0 then label/2.0::double end, len(embedding)/16.0::double) audio_length_s
        from embeddings""",
    "truncate_signal": f"""select vec_id, len(embedding)::double/(label%2+1) audio_length_s,
        least(len(embedding),40*(label%2+1))::int kept, {_weighted("embedding[1:40*(label%2+1)]")} from embeddings""",
    "limit_before_filter": _limited("before"),
    "limit_after_filter": _limited("after"),
    "limit_none": _limited("all"),
    "limit_tied": """with t as (select least(l_suppkey%3,1) k, count(*) c, sum(l_orderkey)::bigint o from lineitem group by 1), h as (select sum(c)//2+7 half from t)
        select k, n::bigint n, case when k=0 then o end orders from (select k, o, case when k=0 then least(c, half) else half-(select c from t where k=0) end n from t, h) where n>0""",
    "batch_ids_tied": """with t as (select l_returnflag, l_suppkey%2 k, count(*) c, sum(l_orderkey)::bigint o from lineitem group by 1,2),
        s as (select *, coalesce(sum(c) over (partition by l_returnflag order by k rows between unbounded preceding and 1 preceding),0) b from t)
        select l_returnflag, k, b::bigint "first", (b+c-1)::bigint "last", c numbers, o orders from s""",
    "longest_topk": "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 256",
    "text_column_resolution": "select conv_id, turn, text original_text from conversations",
    "language_from_config": """select case when doc_id%7=0 then 'en' else lang end as language, count(*) n from documents group by 1""",
    "id_sanitise": """select p_partkey, 'org-'||replace(p_name,' ','-')||'-'||p_brand||'-v1' safe, replace(p_brand,'-','_')||'_v1' card from part""",
    "blank_to_space": f"""with {MARKED}, s as (select doc_id, regexp_replace("text",'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g') t from marked)
        select doc_id, case when t='' then ' ' else t end reference from s""",
    "short_audio_answer": """select event_id, case when "value"/50<0.16 then '.' end pred_text from events""",
    "split_scan": "select doc_id, n_chars from documents where source='src3' and doc_id%3=0",
    "language_split_scan": "select doc_id, 'eng' as language from documents where lang='en'",
    "norm_basic": rf"""select doc_id, {_collapse(rf"lower(regexp_replace(nfc_normalize({_spans('text')}),'[\p{{M}}\p{{S}}\p{{P}}]',' ','g'))")} norm_text
        from documents""",
    "norm_basic_plain": f"select doc_id, {_collapse(_plain(_spans('text')))} norm_text from documents",
    "norm_graphemes": f"""select conv_id, turn, {_collapse(f"array_to_string(string_split({_plain(_spans('text'))},''),' ')")} norm_text
        from conversations""",
    "norm_multilingual": f"select doc_id, {_multilingual('text')} norm_text from documents",
    "norm_pages": f"select page_id, {_multilingual('html')} norm_text from pages",
    "norm_english": f"with recursive {SAID}, {_english('said')} select doc_id, t norm_text from normal",
    "norm_by_language": f"""with recursive {SAID}, {_english("(select * from said where lang='en')")},
        others as (select doc_id, lang, {_multilingual("lower(" + _decomposed('"text"') + ")")} t from said where lang<>'en' or lang is null)
        select doc_id, 'en' lang, t norm_text from normal union all select doc_id, lang, t from others""",
    "norm_numbers": f"""with recursive turns as (select conv_id*1000+turn id, lower({_phrase('conv_id', 'turn')}||' = '||text||' = '||
        {_phrase('conv_id', 'turn')}) t from conversations), {number_sql.fold('turns')}
        select id//1000 conv_id, id%1000 turn, t folded from folded""",
    "norm_number_amounts": f"""with recursive turns as (select conv_id*1000+turn id, lower(array_to_string(list_transform(string_split(conv_id::varchar,''),
            lambda d: ['zero','one','two','three','four','five','six','seven','eight','nine'][d::int+1]),' ')||' hundred dollars = '||text) t from conversations),
        {number_sql.fold('turns')} select id//1000 conv_id, id%1000 turn, t folded, '$'||(id//1000*100) amount from folded""",
    "norm_contractions": _contractions(),
    "norm_digit_groups": r"""select doc_id, regexp_replace(regexp_replace(text,'(\p{Nd}),(\p{Nd})','\1\2','g'),'\.([^0-9]|$)',' \1','g') joined
        from documents""",
    "norm_currency_strip": r"""select doc_id, regexp_replace(regexp_replace(text,'[.$¢€£]([^0-9])',' \1','g'),'([^0-9])%','\1 ','g') stripped
        from documents""",
    "spelling_rewrite": _rewrite(),
    "special_tokens": r"""select conv_id, turn, regexp_replace(regexp_replace('<|en|>'||text||'<|end|> ','^[\s\p{Z}]+|[\s\p{Z}]+$','','g'),'<\|.*?\|>','','g') clean
        from conversations""",
    "answer_parse": """select conv_id, turn, coalesce(try_cast(nullif(translate(regexp_extract(text,'[1-4A-D]'),'ABCD','1234'),'') as int),-1) answer
        from conversations""",
    "prompt_build": f"""select p_partkey, 'Question: '||p_name||chr(10)||'1. '||p_brand||chr(10)||'2. '||p_type||chr(10)||'3. '||p_size||chr(10)||
        '4. '||p_name||chr(10)||chr(10)||{_prompt_tail}||chr(10)||chr(10) "numbered",
        p_name||chr(10)||'A) '||p_brand||chr(10)||'B) '||p_type||chr(10)||'C) '||p_size||chr(10)||'D) '||p_name||chr(10)||'Answer:' lettered
        from part""",
    "segment_join": r"""select doc_id, regexp_replace(chr(10)||replace(text,chr(10),chr(9)||chr(10)||chr(10))||chr(9)||chr(10),
        '^[\s\p{Z}]+|[\s\p{Z}]+$','','g') joined from documents""",
    "nested_segment_join": "select doc_id, replace(replace(text,chr(10),''),' ','') joined from documents",
    "candidate_best": _chosen("asc"),
    "candidate_worst": _chosen("desc"),
    "record_concat": f"""with {RECORDINGS}, best as (select *, row_number() over (partition by record, part order by cer, k) rn from takes),
        whole as (select record, flatten(list(e order by sid)) e from best where rn=1 group by record)
        select record, len(e)::int samples, {_weighted("e")} from whole where len(e)/16.0::double<=22""",
    "record_limit": f"""with {RECORDINGS}, best as (select *, row_number() over (partition by record, part order by cer desc, k) rn from takes),
        whole as (select record, flatten(list(e order by sid)) e from best where rn=1 group by record order by record limit 10)
        select record, len(e)::int samples, {_weighted("e")} from whole where len(e)/16.0::double<=22""",
    "candidate_random": f"""with {RECORDINGS}, n as (select record, part, sid, count(*) n from takes group by all)
        select record, (row_number() over (partition by record order by sid)-1)::int rank, sid::int sentence_id,
        (('0x'||substr(md5(record||':'||sid||':0'),1,8))::bigint % n + 1)::int "position" from n""",
    "flatten_recordings": f"""with {RECORDINGS} select * exclude (e) from (select record,
        (dense_rank() over (partition by record order by part)-1)::int sentence_pos, (pos-1)::int audio_pos, 'sentence '||part "text",
        len(e)::int samples, {_weighted("e")}, e from takes) where samples/16.0::double<=5.5""",
    "mono_mean": """select vec_id, f::int frame, round((embedding[2*f+1]::double+embedding[2*f+2]::double)/2,6) x
        from embeddings, range(32) r(f)""",
    "chunk_plan": """with s as (select doc_id, n_chars, unnest(case when n_chars>300 then range(0,n_chars,200) else [0] end) st from documents)
        select doc_id, (st//200)::int chunk_idx, st::bigint chunk_start,
        (case when n_chars>300 then least(st+250,n_chars) else n_chars end)::bigint chunk_end from s""",
    "chunk_pieces": f"with {CHUNKS} select doc_id, chunk_idx, overlap, substring(chunk_text, overlap+1) piece from pieces",
    "chunk_merge": f"with {CHUNKS} select doc_id, string_agg(substring(chunk_text, overlap+1), '' order by chunk_idx) merged from pieces group by doc_id",
    "chunk_regroup": f"""with {CHUNKS} select doc_id, count(*)::int n, md5(string_agg(chunk_text,'|' order by chunk_idx)) texts_md5 from chunks group by doc_id""",
    "chunk_fold_words": """with recursive f as (select p_partkey, string_split(p_name,' ') w, 1 i, string_split(p_name,' ')[1] merged from part
        union all select p_partkey, w, i+1, merged||substring(w[i+1], 1+coalesce(list_max(list_filter(range(1,length(w[i+1])+1), lambda n:
            len(list_filter(range(1,length(w[i+1])-n+2), lambda s: contains(merged, substring(w[i+1],s,n))))>0)),0)) from f where i<len(w))
        select p_partkey, merged from f where i=len(w)""",
    # One more letter while any piece of that length is in the text so far, then the next turn.
    "chunk_fold_turns": """with recursive t as (select conv_id, text, row_number() over (partition by conv_id order by turn) i, count(*) over (partition by conv_id) n from conversations),
        f as (select conv_id, n, 2 i, 0 shared, text merged from t where i=1
        union all select f.conv_id, f.n, case when more then f.i else f.i+1 end, case when more then shared+1 else 0 end,
            case when more then merged else merged||substring(text, shared+1) end
        from (select f.*, t.text, len(list_filter(range(1, length(t.text)-shared+1), lambda s: contains(merged, substring(t.text, s, shared+1))))>0 more
            from f join t on t.conv_id=f.conv_id and t.i=f.i) f)
        select conv_id, merged from f where i>n""",
    "spelling_table": f"""with d as (select 'p'||p_partkey k, replace(p_name,' ','-') v from part),
        n as (select doc_id, 'p'||(doc_id%199+1) a, 'p'||(doc_id*7%191+1) b, {_multilingual('text')} s from documents),
        w as (select doc_id, unnest(string_split(a||' '||s||' '||b||' p0 '||a, ' ')) x, generate_subscripts(string_split(a||' '||s||' '||b||' p0 '||a, ' '), 1) i from n)
        select doc_id, string_agg(coalesce(v, x), ' ' order by i) rewritten from w left join d on d.k=w.x group by doc_id""",
    "common_substring": """with p as (select p_partkey, upper(p_name) a, p_type b from part),
        i as (select *, unnest(range(1, length(a)+1)) st from p), l as (select *, unnest(range(1, length(a)-st+2)) n from i),
        s as (select p_partkey, substring(a,st,n) c, n, st+n e from l where contains(b, substring(a,st,n))),
        r as (select *, row_number() over (partition by p_partkey order by n desc, e) k from s)
        select p.p_partkey, coalesce(c,'') shared from p left join (select * from r where k=1) r using (p_partkey)""",
    "batch_ids": "select doc_id, n_chars, ((row_number() over (order by n_chars desc, doc_id)-1)//128)::bigint batch_id from documents",
    "batch_amortise": """with b as (select event_id, ((row_number() over (order by event_id)-1)//64)::bigint batch_id from events)
        select batch_id, event_id, round((batch_id%7+1)::double/count(*) over (partition by batch_id),6) transcription_time_s from b""",
    "average_time": """select event_id, event_type, round(length(event_type)*1000.0::double/count(*) over (partition by event_type),6) transcription_time_s
        from events""",
    "page_plan": """with s as (select event_type, count(*) total_rows from events group by 1)
        select event_type, total_rows, o::bigint as "offset", least(100,total_rows-o)::int length from
        (select *, unnest(range(0,total_rows,100)) o from s)""",
    "paged_rows": PAGED,
    "length_buckets": BUCKETS,
    "map_batches_retry": """select doc_id, case when doc_id%40<>13 then (length(text)+8)::int end n,
        case when doc_id%40<>13 and doc_id%25=7 then 2 else 1 end attempts,
        case when doc_id%40=13 then 'unreadable' end as "error" from documents""",
    "map_batches_small": _batch_sizes(96),
    "map_batches_large": _batch_sizes(12_000),
    "map_batches_parallel": """select 4::bigint lanes, count(*) "rows", sum(length(text)+1)::bigint letters, count(*) "right" from documents""",
    "failed_batches": """select lang, count(*) filter (doc_id%40<>13) kept, count(*) filter (doc_id%40=13) dropped,
        max(case when doc_id%40<>13 and doc_id%25=7 then 2 else 1 end) max_attempts from documents group by lang""",
    "map_batches_window": """select lang, count(*) "rows", sum(length(text)+8)::bigint letters, 4::int most_in_flight from documents group by lang""",
    "surviving_batches": """select doc_id, text||' (heard)' predictions from documents where doc_id%40<>13""",
    "map_batches_signals": """select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)),4) total, len(embedding)::int samples
        from embeddings""",
    "paged_source": PAGED,
    "paged_stream": PAGED,
    "stream_rescoring_samples": STREAMED.replace("from runs group by all", """, count(*) + count(*) filter (model_id='org/model-b' and doc_id%3=0) scored
        from runs group by all"""),
    "stream_leaderboard": STREAMED,
    "stream_rescoring": STREAMED,
}
# The same results without Python workers.
ORACLES["norm_english_columns"] = ORACLES["norm_english"]
ORACLES["norm_numbers_columns"] = ORACLES["norm_numbers"]
