"""SQL for DuckDB of operators whose hashes have to be said in arithmetic."""

from __future__ import annotations

from claimlake.llm.simhash import BITS, BUDGET, SEED

#: Fixed values of XXH64.
PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
P1, P2, P3, P4, P5 = (f"{p}::ubigint" for p in PRIMES)
_ALL = f"{2**64}::uhugeint"


def _mul(a: str, b: str) -> str:
    return f"(({a})::uhugeint * {b} % {_ALL})::ubigint"


def _add(a: str, b: str) -> str:
    return f"((({a})::uhugeint + {b}) % {_ALL})::ubigint"


def _turn(a: str, bits: int) -> str:
    return f"(({a})::uhugeint * {2**bits} % {_ALL} + (({a}) >> {64 - bits}))::ubigint"


def _round(acc: str, lane: str) -> str:
    return _mul(_turn(_add(acc, _mul(lane, P2)), 31), P1)


def _merge(h: str, lane: str) -> str:
    return _add(_mul(f"xor({h}, {_round('0::ubigint', lane)})", P1), P4)


def _bytes(at: str, n: int) -> str:
    """The little-endian number of ``n`` bytes of the hexadecimal ``x`` from byte ``at``."""
    return "('0x' || " + " || ".join(f"x[2 * ({at}) + {2 * k + 1}:2 * ({at}) + {2 * k + 2}]" for k in reversed(range(n))) + ")::ubigint"


_STARTS = [(SEED + PRIMES[0] + PRIMES[1]) % 2**64, (SEED + PRIMES[1]) % 2**64, SEED, (SEED - PRIMES[0]) % 2**64]
_LANES = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda j: lanes[4 * j + {c + 1}]), lambda a, l: {_round('a', 'l')}, {start}::ubigint) as v{c + 1}" for c, start in enumerate(_STARTS))
_SUM = _add(_add(_add(_turn("v1", 1), _turn("v2", 7)), _turn("v3", 12)), _turn("v4", 18))
_BIT_SUMS = " + ".join(f"(case when 2 * sum((h >> {b}) & 1) > count(*) then {2**b}::ubigint else 0::ubigint end)" for b in range(BITS))

SIMHASH = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), shingles as (
  select doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from words where len(ws) > 0)
), lanes as (
  select s, n, x, list_transform(range(0, n // 8), lambda i: {_bytes('8 * i', 8)}) as lanes from (select distinct s, strlen(s) as n, hex(encode(s)) as x from shingles)
), stripes as (
  select *, {_LANES} from lanes
), merged as (
  select *, {_SUM} as h1 from stripes
), first as (
  select s, n, x, lanes, {_add(f"case when n < 32 then {(SEED + PRIMES[4]) % 2**64}::ubigint else list_reduce([v1, v2, v3, v4], lambda h, v: {_merge('h', 'v')}, h1) end", "n::ubigint")} as h from merged
), eights as (
  select s, n, x, list_reduce(lanes[4 * (n // 32) + 1:], lambda h, v: {_add(_mul(_turn(f"xor(h, {_round('0::ubigint', 'v')})", 27), P1), P4)}, h) as h from first
), fours as (
  select s, n, x, case when n % 8 >= 4 then {_add(_mul(_turn(f"xor(h, {_mul(_bytes('n // 8 * 8', 4), P1)})", 23), P2), P3)} else h end as h from eights
), ones as (
  select s, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {_bytes('i', 1)}), lambda h, v: {_mul(_turn(f"xor(h, {_mul('v', P5)})", 11), P1)}, h) as h from fours
), hashes as (
  select s, xor(h, h >> 32) as h from (select s, {_mul("xor(h, h >> 29)", P3)} as h from (select s, {_mul("xor(h, h >> 33)", P2)} as h from ones))
), prints as (
  select d.doc_id, coalesce(fp, 0::ubigint) as fp from documents d left join (select doc_id, {_BIT_SUMS} as fp from shingles join hashes using (s) group by doc_id) p on p.doc_id = d.doc_id
), classes as (
  select fp, min(doc_id) as doc_id from prints group by fp
), links as (
  select a.fp as a, b.fp as b from classes a, classes b where bit_count(xor(a.fp, b.fp)::bit) <= {BUDGET}
), reach(fp, other) as (
  select fp, fp from classes union select r.fp, l.b from reach r join links l on l.a = r.other
), home as (
  select r.fp, min(doc_id) as component_id from reach r join classes c on c.fp = r.other group by r.fp
)
select doc_id, lower(lpad(hex(p.fp), 16, '0')) as fingerprint, component_id from prints p join home h on h.fp = p.fp"""

#: CRC-32 bit by bit; near words by what is left when a character is taken out of both, or of the longer one.
SPELLING = r"""
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), counted as (
  select doc_id, run, count(*) as c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs where length(run) >= 7 group by doc_id, run
), hashed as (
  select run, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint),
    lambda h, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(h, b)), 4294967295), 4294967295) as h from counted
), words as (
  select case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, sum(c)::bigint as n from hashed group by all
), vocabulary as (
  select word, n from words where length(word) >= 7 and n >= 2
), cuts as (
  select word, n, i, word[:i] || word[i + 2:] as rest from (select *, unnest(range(length(word))) as i from vocabulary)
), pairs as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join vocabulary b on a.rest = b.word
  union select b.word, a.word, a.n from cuts a join vocabulary b on a.rest = b.word
), near as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from pairs group by word
), formed as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n from vocabulary v left join near r on r.word = v.word
), ways(word, root, steps) as (
  select word, word, 0 from formed union all select w.word, f.form, steps + 1 from ways w join formed f on f.word = w.root where f.form is not null
)
select f.word, form, r.root, n, n_near::bigint as n_near, form_n from formed f join (select word, last(root order by steps) as root from ways group by word) r on r.word = f.word"""
