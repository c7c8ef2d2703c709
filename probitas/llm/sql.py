"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
with recursive texts as (
    select doc_id, string_split(lower(text), chr(10)) as lines from documents where doc_id is not null and text is not null
), lines as (
    select doc_id, generate_subscripts(lines, 1) - 1 as line_no, unnest(lines) as line from texts
), worded as (
    select doc_id, line_no, regexp_extract_all(line, '[\x{E00}-\x{E7F}\x{3000}-\x{9FFF}]|[^ \t\r\f\v\x{E00}-\x{E7F}\x{3000}-\x{9FFF}]+') as ws from lines
), occurring as (
    select doc_id, line_no, ws, array_to_string(ws, ' ') as line from worded where len(ws) > 0
), firsts as (
    select line, any_value(ws) as ws, min({'doc_id': doc_id, 'line_no': line_no}) as spot from occurring group by line
), neighbours as (
    select spot, len(ws) as n, 0 as pos, md5(line) as neighbour from firsts where len(ws) >= 8
    union all
    select spot, len(ws), pos, md5(array_to_string(list_concat(ws[:pos - 1], ws[pos + 1:]), ' '))
    from (select spot, ws, unnest(range(1, len(ws) + 1)) as pos from firsts where len(ws) >= 8)
), near as (
    select a.spot, min(b.spot) as near
    from neighbours a join neighbours b using (neighbour)
    where b.spot < a.spot and (a.n = b.n and a.pos = b.pos or a.n = b.n + 1 and b.pos = 0 or b.n = a.n + 1 and a.pos = 0)
    group by a.spot
), chain as (
    select spot, near as kept, 1 as edits from near
    union all
    select c.spot, n.near, c.edits + 1 from chain c join near n on c.kept = n.spot
), ends as (
    select spot, arg_max(kept, edits) as kept, max(edits) as edits from chain group by spot
), keepers as (
    select line, coalesce(kept, firsts.spot) as kept, coalesce(edits, 0) as edits from firsts left join ends on firsts.spot = ends.spot
)
select o.doc_id, cast(o.line_no as int) as line_no, k.kept.doc_id as kept_doc_id, cast(k.kept.line_no as int) as kept_line_no, cast(k.edits as int) as edits
from occurring o join keepers k using (line)
where {'doc_id': o.doc_id, 'line_no': o.line_no} <> k.kept
"""

MIXING = r"""
with counted as (
    select doc_id, source, md5(text) as row_key, cast(len(regexp_extract_all(text, '[^ \t\n\r\f]+')) as bigint) as tokens
    from documents where doc_id is not null and text is not null
), ordered as (
    select *, md5('17:' || doc_id) as ord from counted where tokens > 0
), shards as (
    select greatest(1, cast(ceil(sum(tokens) / 16000000) as bigint)) as shards from ordered
), placed as (
    select doc_id, source, row_key, tokens, cast(('0x' || substr(ord, 1, 8))::bigint % shards as int) as shard, ord from ordered, shards
), spanned as (
    select *, cast(sum(tokens) over (partition by shard, source order by ord, doc_id, tokens, row_key rows unbounded preceding) as bigint) as stop from placed
), streams as (
    select shard, source, cast(sum(tokens) // 1024 as bigint) as blocks from placed group by shard, source having sum(tokens) >= 1024
), seats as (
    select shard, source, sum(blocks) over (partition by shard) as everything, unnest(range(1, blocks + 1)) as seat from streams
), ranked as (
    select *, row_number() over (partition by shard order by 1.0::double / (2 * seat - 1) desc, source nulls last, seat) as rank from (
        select s.shard, s.source, a.everything, s.seat from seats s join (select shard, sum(blocks) as everything from streams group by shard) a using (shard)
    )
), quotas as (
    select shard, source, count(*) as quota from ranked where rank <= floor(everything * 0.5::double) group by shard, source
), blocks as (
    select shard, source, unnest(range(0, blocks)) as block from streams
), picked as (
    select *, row_number() over (partition by shard, source order by md5('17:' || shard || ':' || block || ':' || coalesce(source, '')), block) as pick from blocks
), chosen as (
    select p.shard, p.source, p.block from picked p join quotas q on p.shard = q.shard and p.source is not distinct from q.source where pick <= quota
), spans as (
    select shard, source, doc_id, row_key, stop - tokens as start, stop, unnest(range((stop - tokens) // 1024, (stop - 1) // 1024 + 1)) as block from spanned
)
select s.shard, s.source, cast(s.block as bigint) as block, s.doc_id, s.row_key,
       cast(greatest(s.start, s.block * 1024) - s.start as bigint) as first_token,
       cast(least(s.stop, (s.block + 1) * 1024) - s.start as bigint) as end_token,
       array_to_string(list_slice(t.tokens, greatest(s.start, s.block * 1024) - s.start + 1, least(s.stop, (s.block + 1) * 1024) - s.start), '') as text
from spans s join chosen c on s.shard = c.shard and s.source is not distinct from c.source and s.block = c.block
join (
    select distinct doc_id, md5(text) as row_key, regexp_extract_all(text, '[ \t\n\r\f]*[^ \t\n\r\f]+(?:[ \t\n\r\f]+$)?') as tokens
    from documents where doc_id is not null and text is not null
) t on s.doc_id = t.doc_id and s.row_key = t.row_key
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

WARC = rf"""
with crlf as (select chr(13) || chr(10) as nl),
dated as (
    select page_id, url, html, nl, case when page_id % 2 <> 0 then 2 else 1 end as version,
           make_timestamp((820454400 + page_id) * 1000000) as ts, 'page-' || page_id || '.arc' as arc_name
    from pages, crlf where page_id is not null and url is not null and html is not null
), blocks as (
    select page_id, 1 as part, 'filedesc://' || arc_name as url, arc_name, ts, nl, version,
           case version when 1 then '1 0 crawl' || chr(10) || 'URL IP-address Archive-date Content-type Archive-length' || chr(10)
                else '2 0 crawl' || chr(10) || 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length' || chr(10) end as block,
           null as body
    from dated
    union all
    select page_id, 2, url, arc_name, ts, nl, version,
           'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html, html
    from dated
), hashed as (
    select *, sha1(block) as block_h, case when body is not null then sha1(body) end as body_h from blocks
), digests as (
    select * exclude (block_h, body_h), (select 'sha1:' || {_BASE32} from (select block_h as h)) as block_digest,
           case when body_h is not null then (select 'sha1:' || {_BASE32} from (select body_h as h)) end as payload_digest
    from hashed
), named as (
    select *, md5(url || '|' || strftime(ts, '%Y%m%d%H%M%S') || '|' || block_digest) as m from digests
), identified as (
    select *, '<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', ('0x' || substr(m, 17, 1))::int % 4 + 1, 1)
           || substr(m, 18, 3) || '-' || substr(m, 21) || '>' as record_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as warc_date
    from named
)
select arc_name,
       case part when 1 then 0 else strlen('filedesc://' || arc_name || ' 0.0.0.0 19960101000000 text/plain ' || case version when 2 then '200 - - 0 ' || arc_name || ' ' else '' end || strlen(first_block) || chr(10)) + strlen(first_block) + 1 end as arc_offset,
       case part when 1 then 'warcinfo' else 'response' end as warc_type, record_id, warc_date,
       case part when 2 then url end as target_uri, case part when 2 then '192.0.2.1' end as ip_address,
       case part when 1 then 'application/warc-fields' else 'application/http; msgtype=response' end as content_type,
       cast(case part when 2 then 200 end as int) as http_status, case part when 2 then 'text/html' end as payload_type, block_digest, payload_digest,
       strlen(block) as content_length, false as truncated,
       'WARC/1.0' || nl || 'WARC-Type: ' || case part when 1 then 'warcinfo' else 'response' end || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: ' || warc_date || nl
       || case part when 1 then 'WARC-Filename: ' || arc_name else 'WARC-Target-URI: ' || url || nl || 'WARC-IP-Address: 192.0.2.1' end || nl || 'WARC-Block-Digest: ' || block_digest || nl
       || case part when 1 then 'Content-Type: application/warc-fields' else 'WARC-Payload-Digest: ' || payload_digest || nl || 'WARC-Identified-Payload-Type: text/html' || nl || 'Content-Type: application/http; msgtype=response' end || nl
       || 'Content-Length: ' || strlen(block) || nl || nl as warc_header,
       block
from (select *, max(case part when 1 then block end) over (partition by page_id) as first_block from identified)
"""
