"""TLS handshakes: hellos of both directions of a connection, paired."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.fingerprints import GREASE, ja3_text, ja3s_text, ja4_parts, no_grease, short_hash
from netloom.operators.flows import TCP_IDLE
from netloom.operators.ordered import along, vlan_list
from netloom.operators.streams import directions
from netloom.sources import tls, x509
from netloom.sources.tls_record import escape

_LISTS = {"client_supported_groups": tls.GROUPS, "client_signature_algorithms": tls.SIGNATURES, "client_supported_versions": tls.VERSIONS, "client_ec_point_formats": tls.POINTS, "client_alpn": tls.ALPN}
_ROW = (
    "filename string, section_number long, interface_id long, ip_version short, client_ip string, server_ip string, client_port int, server_port int, client_stream_id long, server_stream_id long, handshake_number long, first_packet_number long, last_packet_number long, first_us long, last_us long, "
    "client_hello boolean, server_hello boolean, tls_sni string, client_version int, negotiated_version int, cipher_suite int, session_resumed boolean, reassembly_status string, reassembly_error string, vlans string, "
    "client_cipher_suites array<int>, client_extensions array<int>, client_supported_groups array<int>, client_signature_algorithms array<int>, client_supported_versions array<int>, client_ec_point_formats array<smallint>, client_alpn array<string>, server_extensions array<int>, server_alpn string, warnings array<string>, "
    f"server_certificates array<{x509.TYPE}>, tunnel struct<protocol:string,destination:string,client_prefix_bytes:long,server_prefix_bytes:long>, client_certificates array<{x509.TYPE}>, server_version int, bad array<int>"
)


#: GREASE values as two-byte protocol names, escaped as the parser escapes them.
_GREASE_ALPN = [escape(bytes([g >> 8, g & 255])) for g in GREASE]


class _Pairing:
    """Directions of one connection in order; the n-th with client hellos meets the n-th with server hellos."""

    def __init__(self):
        self.sides: dict[bool, list[tuple[object, tls.Side]]] = {True: [], False: []}

    def row(self, d) -> Iterator[tuple]:
        data = d.chunks[0]["data"] if d.chunks and d.chunks[0]["offset"] == 0 else b""
        if d.reassembly_status not in ("conflict", "limit"):
            side = tls.read_side(data, d.syn_seen, bool(d.gaps))
            if side:
                self.sides[side.hellos[0].client].append((d, side))
        return iter(())

    def end(self) -> Iterator[tuple]:
        clients, servers = self.sides[True], self.sides[False]
        for i in range(max(len(clients), len(servers))):
            c = clients[i] if i < len(clients) else None
            s = servers[i] if i < len(servers) else None
            if any(x and not x[0].syn_seen and x[1].prefix and not y for x, y in ((c, s), (s, c))):
                continue  # found in the middle of a stream, and nothing confirms it
            n = max(len(x[1].hellos) for x in (c, s) if x)
            for k in range(n):
                yield _merge(c, s, k)


def _pick(x: tuple[object, tls.Side] | None, k: int) -> tls.Hello | None:
    return x[1].hellos[k] if x and k < len(x[1].hellos) else None


def _stamps(x: tuple[object, tls.Side] | None, h: tls.Hello | None) -> list[tuple[int, int | None]]:
    if not x or not h:
        return []
    a, b = h.span
    return [(o["packet"], o["us"]) for o in x[0].origins if o["offset"] < b and o["offset"] + o["length"] > a]


def _merge(c: tuple[object, tls.Side] | None, s: tuple[object, tls.Side] | None, k: int) -> tuple:
    ch, sh = _pick(c, k), _pick(s, k)
    d = c[0] if c else s[0]
    ends = (d.src_ip, d.dst_ip, d.src_port, d.dst_port) if c else (d.dst_ip, d.src_ip, d.dst_port, d.src_port)
    stamps = sorted(_stamps(c, ch) + _stamps(s, sh))
    first, last = (stamps[0], stamps[-1]) if stamps else ((None, None), (None, None))
    version = (sh.selected or sh.version) if sh and sh.status is None else None
    resumed = bool(ch.session) and ch.session == sh.session if ch and sh and version is not None and version != 0x0304 and not ch.status and not sh.status else None
    status, error = next(((x.status, x.error) for x in (ch, sh) if x and x.status), (None, None))
    for side, h in ((c, ch), (s, sh)):
        if status is None and side and h and side[1].status:
            status, error = side[1].status, side[1].error
    status = status or ("complete" if ch and sh else "one-sided")
    cp, sp = (x[1].prefix if x and k == 0 else 0 for x in (c, s))
    ct, st = (x[1].tunnel if x and k == 0 else None for x in (c, s))
    said = [
        (ch is None, "client_hello_missing"), (sh is None, "server_hello_missing"), (ch is not None and ch.status == "invalid", "client_hello_invalid"), (sh is not None and sh.status == "invalid", "server_hello_invalid"),
        (ch is not None and bool(ch.bad), "client_list_malformed"), (sh is not None and bool(sh.bad), "server_list_malformed"),
        (sh is not None and None in (sh.certificates or []), "server_certificate_malformed"), (ch is not None and None in (ch.certificates or []), "client_certificate_malformed"),
        (cp > 0 and not ct, "client_tunnel_unrecognized"), (sp > 0 and not st, "server_tunnel_unrecognized"),
        (ch is not None and not c[0].syn_seen and cp > 0, "client_prefix_unanchored"), (sh is not None and not s[0].syn_seen and sp > 0, "server_prefix_unanchored"),
        (bool(ct and st) and ct != st and (ct, st) != ("socks4a", "socks4"), "tunnel_mismatch"),
    ]
    tunnel = {"protocol": ct or st, "destination": c[1].destination if c and ct else None, "client_prefix_bytes": cp if c else None, "server_prefix_bytes": sp if s else None} if cp or sp else None
    lists = [(ch.lists.get(code) if ch and not ch.status else None) for code in _LISTS.values()]
    return (
        d.filename, d.section_number, d.interface_id, d.ip_version, *ends, c[0].stream_id if c else None, s[0].stream_id if s else None, k + 1, first[0], last[0], first[1], last[1],
        ch is not None, sh is not None, ch.sni if ch else None, ch.version if ch else None, version, sh.suite if sh else None, resumed, status, error, d.vlans,
        ch.suites if ch else None, ch.extensions if ch else None, *lists, sh.extensions if sh else None, (sh.lists.get(tls.ALPN) or [None])[0] if sh else None, [t for ok, t in said if ok],
        sh.certificates if sh else None, tunnel, ch.certificates if ch else None, sh.version if sh else None, sorted(ch.bad) if ch else [],
    )


def read_tls(packets: DataFrame, tcp_idle_timeout: timedelta = TCP_IDLE) -> DataFrame:
    """One row per TLS handshake: both hellos, their lists with and without GREASE, fingerprints, certificates and tunnel.

    The n-th hello of a client's direction pairs with the n-th of its server's; a side that wasn't captured leaves its
    columns null. A hello is looked for in the first 8 KiB of a direction, behind SOCKS, HTTP CONNECT and STARTTLS dialogues
    too. Fingerprints are native expressions over the lists, so they cost nothing where they aren't selected; JA4S and JA4X,
    bound to a restrictive licence, stay null.
    """
    d = directions(packets, tcp_idle_timeout).filter("has_row")
    d = d.withColumn("_low", F.least(F.struct("src_ip", "src_port"), F.struct(F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"))))
    d = d.withColumn("_high", F.greatest(F.struct("src_ip", "src_port"), F.struct(F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"))))
    d = d.withColumn("pair", F.concat_ws("|", F.col("_low.src_ip"), F.col("_low.src_port").cast("string"), F.col("_high.src_ip"), F.col("_high.src_port").cast("string"))).drop("_low", "_high")
    h = along(d, ["filename", "input_index", "section_number", "interface_id", "vlans", "pair"], ["first_packet_number"], _Pairing, _ROW)
    bad = F.col("bad")
    ok3 = ~F.arrays_overlap(bad, F.array(F.lit(tls.GROUPS), F.lit(tls.POINTS)))
    ok4 = ~F.arrays_overlap(bad, F.array(F.lit(tls.VERSIONS), F.lit(tls.SIGNATURES), F.lit(tls.ALPN)))
    three = F.when(ok3, ja3_text("client_version", "client_cipher_suites", "client_extensions", "client_supported_groups", "client_ec_point_formats"))
    threes = ja3s_text("server_version", "cipher_suite", "server_extensions")
    prefix, first, second = ja4_parts("client_version", "client_cipher_suites", "client_extensions", "client_supported_versions", "client_signature_algorithms", "client_alpn")
    prefix = F.when(ok4, prefix)
    none = F.lit(None).cast("string")

    def stamp(c: str):
        return F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))

    def twins(*cols: str):
        return [x for c in cols for x in (F.col(c), no_grease(c).alias(f"{c}_no_grease"))]

    alpn = F.filter("client_alpn", lambda x: ~x.isin(_GREASE_ALPN))
    return h.select(
        "filename", "section_number", "interface_id", "ip_version", "client_ip", "server_ip", "client_port", "server_port", "client_stream_id", "server_stream_id", "handshake_number", "first_packet_number", "last_packet_number",
        stamp("first_us").alias("first_timestamp"), stamp("last_us").alias("last_timestamp"), "client_hello", "server_hello", "tls_sni", "client_version", "negotiated_version", "cipher_suite", "session_resumed", "reassembly_status", "reassembly_error", vlan_list().alias("vlan_ids"),
        *twins("client_cipher_suites", "client_extensions", "client_supported_groups", "client_signature_algorithms", "client_supported_versions"), "client_ec_point_formats", "client_alpn", alpn.alias("client_alpn_no_grease"),
        "server_extensions", no_grease("server_extensions").alias("server_extensions_no_grease"), "server_alpn", "warnings", F.md5(three).alias("ja3"), three.alias("ja3_full"), F.md5(threes).alias("ja3s"), threes.alias("ja3s_full"),
        F.concat_ws("_", F.when(prefix.isNotNull(), prefix), F.when(prefix.isNotNull(), short_hash(first)), F.when(prefix.isNotNull(), short_hash(second))).alias("_ja4"), F.when(prefix.isNotNull(), F.concat_ws("_", prefix, first, second)).alias("ja4_r"), none.alias("ja4s"), none.alias("ja4s_r"),
        "server_certificates", "tunnel", "client_certificates",
    ).withColumn("ja4", F.nullif(F.col("_ja4"), F.lit(""))).select(*_ORDER)


_ORDER = (
    "filename section_number interface_id ip_version client_ip server_ip client_port server_port client_stream_id server_stream_id handshake_number first_packet_number last_packet_number first_timestamp last_timestamp client_hello server_hello tls_sni "
    "client_version negotiated_version cipher_suite session_resumed reassembly_status reassembly_error vlan_ids client_cipher_suites client_cipher_suites_no_grease client_extensions client_extensions_no_grease client_supported_groups client_supported_groups_no_grease "
    "client_signature_algorithms client_signature_algorithms_no_grease client_supported_versions client_supported_versions_no_grease client_ec_point_formats client_alpn client_alpn_no_grease server_extensions server_extensions_no_grease server_alpn warnings "
    "ja3 ja3_full ja3s ja3s_full ja4 ja4_r ja4s ja4s_r server_certificates tunnel client_certificates"
).split()
