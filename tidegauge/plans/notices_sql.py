"""The judgement of notices as DuckDB SQL: the same cues over a table of lines instead of arrays."""

from __future__ import annotations

from tidegauge.operators import notices as n


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def plain(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern, by in n.MARKUP:
        by = by.replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{by}', 'g')"
    return rf"trim(regexp_replace({out}, '^\n+|\n+$', '', 'g'))"


def words(text: str) -> str:
    return rf"' ' || trim(regexp_replace(regexp_replace(lower({text}), '[''’]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def says(w: str, phrases: str) -> str:
    return f"regexp_matches({w}, ' (?:{phrases}) ')"


def opens(w: str, phrases: str) -> str:
    return f"regexp_matches({w}, '^ (?:{phrases}) ')"


def says_then(w: str, first: str, then: str, gap: int) -> str:
    return f"regexp_matches({w}, ' (?:{first}) (?:[^ ]+ ){{0,{gap}}}(?:{then}) ')"


def whole(w: str, phrases: str) -> str:
    return f"regexp_matches({w}, '^ (?:{phrases}) $')"


def first(condition: str, name: str) -> str:
    return f"coalesce(arg_min(line, k) filter ({condition}), '') as {name}"


def listed(name: str, starts: str, counts: str, window: int) -> str:
    """The quote of the first start with two counted lines after it, before its section ends."""
    return f"""{name}_from as (select *, coalesce(lag(past) over (partition by gid order by k), false) before_past from lines),
{name}_pair as (select a.gid, a.k, a.line head, b.k b_k, b.line, a.words head_words, b.words, b.change, b.item, b.feature, min(b.k) filter (b.ends) over (partition by a.gid, a.k) stop from {name}_from a join lines b on b.gid = a.gid and b.k > a.k and b.k <= a.k + {window} where {starts}),
{name}_hit as (select gid, k, any_value(head) head, list(line order by b_k) found from {name}_pair where (stop is null or b_k < stop) and ({counts}) group by 1, 2 having count(*) >= 2),
{name} as (select gid, arg_min(head || chr(10) || found[1] || chr(10) || found[2], k) quote from {name}_hit group by 1)"""


def judged(source: str) -> str:
    """source: a select of gid, title, contents, tags."""
    c, d = n.CUES, n.DEPLOYABLE
    cue = lambda w, name: says(w, c[name])
    pending = f"({says_then('words', d + '|version', n.PENDING, 10)} or ({says('words', n.PENDING)} and {says('words', 'flash update|undergo an update')}))"
    heading = f"length(a.line) <= {n.HEADING_CHARS} and not a.past and ({whole('a.words', n.HEADINGS)} or regexp_matches(a.words, '^ (?:[^ ]+ ){{0,12}}(?:changelog|patch notes) (?:[^ ]+ ){{0,6}}$'))"
    told = f"{cue('a.words', 'introduces')} and not a.past and not a.before_past"
    until = "not be deployed until|not be released until|not go live until|wont be deployed until|wont be released until|wont go live until"
    dated = says_then("tw", n.ARRIVES, f"next|tomorrow|this (?:{n.DAYS})|on [0-9]+|on (?:{n.MONTHS})", 14)
    excluded = [
        (cue("iw", "unaffected"), "MAIN_GAME_UNAFFECTED", "unaffected_line"), (f"({cue('tw', 'announced')} or {dated})", "ANNOUNCEMENT_OR_PREVIEW", "t"), ("deployed = '' and pending <> ''", "FUTURE_DEPLOYMENT", "pending"),
        (f"proof = '' and {cue('tw', 'goods')}", "PROMOTION_OR_MERCHANDISE", "t"), (f"proof = '' and {cue('iw', 'submission')}", "COMMUNITY_SUBMISSION", "submission_line"),
        (f"proof = '' and {cue('tw', 'community')}", "COMMUNITY_NEWS", "t"), (f"deployed = '' and {cue('tw', 'recap')}", "RETROSPECTIVE_OR_STATUS_NEWS", "t"),
    ]
    verdict = lambda decision, stage, reason, evidence, scope="scope": f"{{'decision': {decision}, 'scope': {scope}, 'stage': {stage}, 'reason': {reason}, 'evidence': {evidence}}}"
    review, patch = "'REVIEW_REQUIRED'", "'PATCH'"
    rules = [
        ("t = '' or b = ''", verdict(review, 0, "'MISSING_TITLE_OR_BODY'", "t")), ("other <> ''", verdict(review, 2, "'UPDATE_TARGET_REQUIRES_VERIFICATION'", "other", "'OTHER_GAME'")),
        (f"{cue('tw', 'handheld')} and not {cue('tw', 'desktop')}", verdict(review, 2, "'MOBILE_PLATFORM_REQUIRES_VERIFICATION'", "t", "'NON_STEAM'")),
        ("waits <> '' and ready <> ''", verdict(review, 2, "'TEST_AVAILABLE_LIVE_DEPLOYMENT_PENDING'", "waits || chr(10) || ready", "'MIXED'")), ("waits <> ''", verdict(review, 2, "'DEFERRED_DEPLOYMENT_REQUIRES_VERIFICATION'", "waits")),
        *((holds, verdict("case when tagged then 'REVIEW_REQUIRED' else 'NOT_PATCH' end", 2, f"case when tagged then 'TAG_CONFLICT_{reason}' else '{reason}' end", evidence)) for holds, reason, evidence in excluded),
        ("fixed <> ''", verdict(patch, 5, "'COMPLETED_CLIENT_SECURITY_FIX'", "fixed")), (f"{cue('tw', 'release')} and proof <> ''", verdict(patch, 3, "'RELEASE_WITH_CHANGE_EVIDENCE'", "proof")),
        (cue("tw", "release"), verdict(review, 3, "'RELEASE_SCOPE_UNCLEAR'", "t")), ("tagged", verdict(patch, 1, "'PATCHNOTES_TAG'", "'patchnotes'")), (cue("tw", "patch"), verdict(patch, 4, "'PATCH_TITLE'", "t")),
        (f"{cue('tw', 'update')} and (proof <> '' or n_changes >= 2)", verdict(patch, 4, "'UPDATE_TITLE_WITH_CHANGES'", "t")), (cue("tw", "update"), verdict(review, 4, "'UPDATE_TITLE_ONLY'", "t")), ("proof <> ''", verdict(patch, 5, "'BODY_CHANGE_EVIDENCE'", "proof")),
    ]
    chosen = "case " + " ".join(f"when {holds} then {v}" for holds, v in rules) + f" else {verdict(review, 5, quoted_reason('INSUFFICIENT_EVIDENCE'), 't')} end"
    return rf"""with n as ({source}),
p as (select gid, trim({plain('title')}) t, {plain('contents')} b, tags from n),
raw as (select gid, trim(unnest(string_split(b, chr(10)))) line, generate_subscripts(string_split(b, chr(10)), 1) pos from p),
bare as (select gid, row_number() over (partition by gid order by pos) k, line, trim(regexp_replace(line, '^(?:[-*•–]|\d+[.)])\s*', '')) bare from raw where line <> ''),
part as (select *, {words('bare')} as words, {words("case when " + says(words("regexp_extract(bare, '^\\[([^\\]]*)\\]', 1)"), "next|planned|preview|upcoming") + " then bare else trim(regexp_replace(bare, '^(?:\\[[^\\]]*\\]\\s*)+', '')) end")} as own, {words(r"regexp_extract(bare, '^[\p{L}\p{N}_/(). -]{1,70}:\s+(.*)$', 1)")} as component from bare),
lines as (select gid, k, line, words, not {opens('words', c['condition'])} and length(trim(own)) >= 8 and ({opens('own', n.CHANGED)} or {opens('component', n.CHANGE + '|' + n.CHANGED)} or {says_then('words', n.BEING, n.CHANGED, 0)}) as change,
    regexp_matches(line, '^[-*•]\s') and not {opens('words', c['condition'])} and length(line) >= 10 as item, {opens('words', n.ENDS_SECTION)} or {cue('words', 'not current')} as ends, {cue('words', 'not current')} as past, regexp_matches(line, '^(?:[-*•]\s*)?[\p{{L}}\p{{N}}][^-–—]{{1,70}}\s[-–—]\s.{{25,}}$') as feature from part),
{listed('section', heading, f"change or (item and {whole('head_words', n.CATEGORIES)})", n.SECTION_LINES)},
{listed('told', told, 'change or feature', n.NARRATIVE_LINES)},
changes as (select gid, count(*) n_changes, min(k) first_change, arg_min(line, k) change_line from lines where change group by 1),
titled as (select gid, k, line, words from lines union all select gid, 0, t, {words('t')} from p),
outs as (select gid, {first(says('words', d) + ' and ' + says_then('words', d, n.OUT, 14), 'out_now')} from titled group by 1),
cues as (select gid, {', '.join(first(cue('words', x), y) for x, y in (('client fix', 'client_line'), ('server fix', 'server_line'), ('live hotfix', 'hotfix_line'), ('test ready', 'ready'), ('unaffected', 'unaffected_line'), ('submission', 'submission_line')))}, {first(says_then('words', 'patch notes|this patch|this update', until, 2), 'waits')} from lines group by 1),
pend as (select l.gid, {first(pending, 'pending')} from lines l left join changes c on c.gid = l.gid where first_change is null or k < first_change group by 1),
a as (select p.*, {words('t')} as tw, {words(f'left(b, {n.INTRO_CHARS})')} as iw, coalesce(n_changes, 0) n_changes, change_line, s.quote section, o.quote told, out_now, client_line, server_line, hotfix_line, coalesce(ready, '') ready, unaffected_line, submission_line, coalesce(waits, '') waits, coalesce(pending, '') pending,
    coalesce(regexp_extract(left(b, {n.INTRO_CHARS}), '(?i)\bupdate for ([^.!?\n]{{1,100}}?) is (?:now )?(?:available|live)\b', 1), '') other, coalesce(len(list_filter(string_split(tags, ','), lambda x: lower(trim(x)) = 'patchnotes')) > 0, false) tagged
    from p left join changes c on c.gid = p.gid left join section s on s.gid = p.gid left join told o on o.gid = p.gid left join outs u on u.gid = p.gid left join cues q on q.gid = p.gid left join pend e on e.gid = p.gid),
f as (select *, case when {cue('iw', 'client fix')} then coalesce(client_line, '') else '' end fixed from a),
d as (select *, coalesce(nullif(out_now, ''), case when {says('tw', 'fixed')} then nullif(server_line, '') end, case when n_changes > 0 and {cue('iw', 'live hotfix')} then nullif(hotfix_line, '') end, nullif(fixed, ''), '') deployed from f),
e as (select *, coalesce(nullif(deployed, ''), section, case when n_changes >= 2 and (regexp_matches(t, '^[vV]?\d+(?:\.\d+){{1,3}}(?:[-.]?[A-Za-z]\d*)?$') or {cue('tw', 'changelog')}) then t || chr(10) || change_line end, told, '') proof, {cue('tw', 'test build')} or {cue('iw', 'test only')} or ready <> '' as test from d),
g as (select *, case when test and {cue('tw', 'live build')} then 'MIXED' when test then 'TEST' when fixed <> '' then 'CLIENT' else 'DEFAULT' end scope from e),
h as (select gid, {chosen} v from g)
select gid, v['decision'] decision, v['scope'] as scope, cast(v['stage'] as int) stage, v['reason'] reason, v['evidence'] evidence from h"""


def quoted_reason(code: str) -> str:
    return f"'{code}'"
