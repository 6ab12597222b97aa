"""DuckDB text of the bindings in ``sources.bindings``; the oracles build on these CTEs."""

from packetloom.sources.bindings import CATEGORIES, SUITE_IDS

_K = "cast(props->>'k' as int)"
_EV = f"""ev as (select event_id, user_id, event_type, value, {_K} as k, epoch_us(ts) as us,
 cast(1704067200000000 + floor((epoch_us(ts) - 1704067200000000) / 8640) as bigint) as ts_us from events)"""

CTES = {
    "ev": _EV,
    "packets": """packets as (select event_id as pkt_id, ts_us, concat('sensor-', cast(event_id % 3 as varchar)) as node_id,
 concat('10.0.', cast(cast(floor(user_id / 250) as int) as varchar), '.', cast(user_id % 250 as varchar)) as src_ip,
 concat('192.168.1.', cast(k % 16 as varchar)) as dst_ip, cast(40000 + event_id % 64 as int) as src_port, cast(20 + k as int) as dst_port,
 case event_type when 'view' then 'TCP' when 'click' then 'TCP' when 'purchase' then 'UDP' when 'signup' then 'DNS' else 'ICMP' end as protocol,
 cast(40 + floor(value * 4) as bigint) as size,
 case when event_type in ('view','click') then cast((event_id * 7 + k) % 64 as int) else 0 end as tcp_flags, cast(1 + k % 64 as int) as ttl from ev)""",
    "conv": """conv as (select event_id as pkt_id, ts_us, concat('sensor-', cast(event_id % 3 as varchar)) as node_id,
 case when event_id % 3 = 0 then 'B' else 'A' end as side,
 concat('10.0.0.', cast((user_id % 250) % 8 as varchar)) as host, cast(40000 + (user_id % 250) % 4 as int) as hport,
 concat('192.168.1.', cast(k % 4 as varchar)) as peer,
 case when event_id % 3 = 0 then peer else host end as src_ip, case when event_id % 3 = 0 then host else peer end as dst_ip,
 case when event_id % 3 = 0 then 443 else hport end as src_port, case when event_id % 3 = 0 then hport else 443 end as dst_port,
 case when event_type in ('view','click') then 'TCP' else 'UDP' end as protocol, cast(40 + floor(value * 4) as bigint) as size,
 case when event_type in ('view','click') then cast((event_id * 7 + k) % 64 as int) else 0 end as tcp_flags, cast(1 + k % 64 as int) as ttl from ev)""",
    "scores": """scores as (select event_id as row_id, concat('u', cast(user_id as varchar)) as flow_key, us as ts_us,
 least(1.0e0, value / 400) as score, case when event_type = 'error' then 1 else 0 end as y, event_type as label from ev)""",
    "tls": f"""tls as (select event_id as sess_id, ts_us, concat('10.0.0.', cast(user_id as varchar)) as host_ip, k % 3 = 0 as has_pq,
 cast(771 + k % 2 as int) as tls_version, ([{', '.join(map(str, SUITE_IDS))}])[1 + k % {len(SUITE_IDS)}] as cipher_suite from ev where event_type in ('view','click'))""",
    "dns": r"""w0 as (select doc_id, regexp_split_to_array(text, '\s+') as ws from documents),
 w1 as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from w0),
 dns as (select doc_id * 1000000 + pos as q_id, cast(1704067200000000 + doc_id * 100000 + pos * 1000 as bigint) as ts_us,
 concat('10.1.0.', cast(doc_id % 50 as varchar)) as src_ip,
 concat(word, '.', case when pos % 10 = 0 then 'google.com' else 'example.net' end) as name, pos % 4 = 3 as is_response from w1 where word <> '')""",
    "arp": """arp as (select event_id as arp_id, ts_us, case when event_type = 'signup' then 1 else 2 end as opcode,
 concat('02:00:00:00:', case when k < 15 then 'ff' else '00' end, ':', lpad(cast(user_id % 100 as varchar), 2, '0')) as sender_mac,
 concat('10.2.0.', cast(user_id as varchar)) as sender_ip from ev)""",
    "icmp": """icmp as (select conv_id * 1000 + turn as icmp_id, cast(1704067200000000 + conv_id * 500000 + turn * 1000 as bigint) as ts_us,
 concat('10.3.0.', cast(conv_id % 7 as varchar)) as src_ip, concat('192.168.3.', cast(turn as varchar)) as dst_ip, encode(text) as payload from conversations)""",
    "alerts": f"""alerts as (select event_id as alert_id, ts_us, cast(1 + k % 5 as int) as severity,
 ([{', '.join(repr(c) for c in CATEGORIES)}])[1 + k % {len(CATEGORIES)}] as category, concat('10.0.0.', cast(user_id as varchar)) as source_ip,
 concat('192.168.1.', cast(k % 16 as varchar)) as dest_ip, cast(20 + k as int) as dest_port, (k % 10) / 10 as confidence,
 concat(category, ' seen from user ', cast(user_id as varchar)) as description from ev)""",
    "ml": """ml as (select event_id as ml_id, ts_us, concat('10.0.0.', cast(user_id as varchar)) as flow_key,
 least(1.0e0, value / 400) as anomaly_score, 'iforest' as detector_type from ev)""",
    "beats": """beats as (select concat('node-', cast(user_id as varchar)) as node_id, ts_us, value as uptime, event_id as packets_sent from ev)""",
    "env": """env as (select event_id as env_id, concat('peer-', cast(user_id as varchar)) as sender_id, ts_us as recv_ts_us,
 event_id + k * 20 as seq, ts_us - k * 500000 as sent_ts_us from ev)""",
    "spans": """spans as (select cast(1704067200000000 + r_regionkey * 60000000 as bigint) as start_us,
 cast(1704067200000000 + r_regionkey * 60000000 + 20000000 + r_regionkey * 5000000 as bigint) as end_us, concat('attack-', lower(r_name)) as label from region)""",
    "feats": """feats as (select vec_id as row_id, embedding as features, cast(label as varchar) as label, cast(label = 9 as int) as y from embeddings)""",
}
_NO_EV = {"dns", "icmp", "spans", "feats"}


def with_(uses: str, body: str, doubles: str = "", recursive: bool = False) -> str:
    """SQL over the named CTEs; ``doubles`` are rounded to 6 places."""
    names = uses.split()
    parts = ([CTES["ev"]] if any(n not in _NO_EV for n in names) else []) + [CTES[n] for n in names if n != "ev"]
    head, tail = body.rsplit("select_final", 1) if "select_final" in body else ("", body)
    ctes = ",\n".join(parts + ([head.strip().rstrip(",")] if head.strip() else []))
    if not ctes:
        return body if not doubles else f"select * replace ({', '.join(f'round({d} + 3e-10, 6) + 0.0e0 as {d}' for d in doubles.split())}) from ({body})"
    final = ("select" + tail) if head or "select_final" in body else tail
    if doubles:
        reps = ", ".join(f"round({d} + 3e-10, 6) + 0.0e0 as {d}" for d in doubles.split())
        final = f"select * replace ({reps}) from ({final})"
    return f"with {'recursive ' if recursive else ''}{ctes}\n{final}"
