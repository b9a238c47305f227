"""Fields of X.509 certificates in DER. Nothing is verified; a certificate that breaks the encoding gives None."""

from __future__ import annotations

import hashlib
import ipaddress
from datetime import datetime

TYPE = (
    "struct<subject:string,issuer:string,serial:string,not_before:timestamp_ntz,not_after:timestamp_ntz,san_dns:array<string>,san_ip:array<string>,ja4x:string,ja4x_r:string,sha1:string,sha256:string,"
    "signature_algorithm:string,public_key_algorithm:string,public_key_bits:long,public_key_curve:string,is_ca:boolean,path_length:long,key_usage:array<string>,extended_key_usage:array<string>,"
    "subject_key_id:string,authority_key_id:string,ocsp_urls:array<string>,ca_issuers_urls:array<string>,crl_urls:array<string>,policies:array<string>>"
)

# --- Fixed values: object identifiers and what they are called --------------------------------------------------------
ATTRIBUTES = {
    "2.5.4.3": "CN", "2.5.4.4": "SN", "2.5.4.5": "serialNumber", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "STREET", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.12": "title", "2.5.4.42": "GN",
    "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID", "1.2.840.113549.1.9.1": "emailAddress",
}
ALGORITHMS = {
    "1.2.840.113549.1.1.1": "rsaEncryption", "1.2.840.113549.1.1.4": "md5WithRSAEncryption", "1.2.840.113549.1.1.5": "sha1WithRSAEncryption", "1.2.840.113549.1.1.10": "rsassaPss", "1.2.840.113549.1.1.11": "sha256WithRSAEncryption",
    "1.2.840.113549.1.1.12": "sha384WithRSAEncryption", "1.2.840.113549.1.1.13": "sha512WithRSAEncryption", "1.2.840.113549.1.1.14": "sha224WithRSAEncryption", "1.2.840.10040.4.1": "dsaEncryption", "1.2.840.10045.2.1": "id-ecPublicKey",
    "1.2.840.10045.4.1": "ecdsa-with-SHA1", "1.2.840.10045.4.3.1": "ecdsa-with-SHA224", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.2.840.10045.4.3.4": "ecdsa-with-SHA512",
    "1.3.101.110": "X25519", "1.3.101.111": "X448", "1.3.101.112": "ED25519", "1.3.101.113": "ED448",
}
CURVES = {"1.2.840.10045.3.1.7": ("prime256v1", 256), "1.3.132.0.34": ("secp384r1", 384), "1.3.132.0.35": ("secp521r1", 521), "1.3.132.0.10": ("secp256k1", 256), "1.3.132.0.33": ("secp224r1", 224), "1.2.840.10045.3.1.1": ("prime192v1", 192)}
KEY_BITS = {"ED25519": 253, "ED448": 456, "X25519": 253, "X448": 448}
PURPOSES = {
    "2.5.29.37.0": "anyExtendedKeyUsage", "1.3.6.1.5.5.7.3.1": "serverAuth", "1.3.6.1.5.5.7.3.2": "clientAuth", "1.3.6.1.5.5.7.3.3": "codeSigning", "1.3.6.1.5.5.7.3.4": "emailProtection", "1.3.6.1.5.5.7.3.8": "timeStamping", "1.3.6.1.5.5.7.3.9": "OCSPSigning",
}
USAGES = ("digitalSignature", "nonRepudiation", "keyEncipherment", "dataEncipherment", "keyAgreement", "keyCertSign", "cRLSign", "encipherOnly", "decipherOnly")
SEQUENCE, SET, OID, BITS, OCTETS, INTEGER, BOOLEAN = 0x30, 0x31, 6, 3, 4, 2, 1
TEXTS = {12: "utf-8", 19: "ascii", 22: "ascii", 20: "latin-1", 30: "utf-16-be", 28: "utf-32-be"}
MOST_ENTRIES = 1024


class BadDer(Exception):
    """The bytes are not what their encoding promises."""


class Der:
    """Elements of a constructed value, one after another: (tag, content, whole encoding)."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def more(self) -> bool:
        return self.at < len(self.raw)

    def next(self, tag: int | None = None) -> tuple[int, bytes, bytes]:
        raw, start = self.raw, self.at
        if start + 2 > len(raw):
            raise BadDer
        t, n, at = raw[start], raw[start + 1], start + 2
        if t & 31 == 31 or n == 0x80:
            raise BadDer
        if n > 0x80:
            width = n & 0x7F
            if width > 4 or at + width > len(raw):
                raise BadDer
            n = int.from_bytes(raw[at : at + width], "big")
            if n < 0x80 or n >> 8 * (width - 1) == 0:
                raise BadDer
            at += width
        if at + n > len(raw) or (tag is not None and t != tag):
            raise BadDer
        self.at = at + n
        return t, raw[at : at + n], raw[start : at + n]

    def inside(self, tag: int = SEQUENCE) -> Der:
        return Der(self.next(tag)[1])

    def peek(self) -> int:
        return self.raw[self.at] if self.more() else -1


def oid(raw: bytes) -> str:
    if not raw or raw[-1] & 0x80:
        raise BadDer
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _escaped(text: str) -> str:
    """A name's value after RFC 4514."""
    out = "".join("\\" + c if c in '",+;<>\\' else "\\00" if c == "\0" else c for c in text)
    if out[:1] in (" ", "#"):
        out = "\\" + out
    return out[:-1] + "\\ " if len(out) > 1 and out.endswith(" ") else out


def name(der: Der) -> str:
    """A distinguished name after RFC 4514: last part first."""
    parts = []
    while der.more():
        pairs = []
        part = der.inside(SET)
        if not part.more():
            raise BadDer
        while part.more():
            pair = part.inside()
            kind = oid(pair.next(OID)[1])
            tag, raw, whole = pair.next()
            short = ATTRIBUTES.get(kind)
            try:
                text = raw.decode(TEXTS[tag]) if short else None
            except (KeyError, UnicodeDecodeError):
                text = None
            pairs.append(f"{short}={_escaped(text)}" if text is not None else f"{short or kind}=#{whole.hex().upper()}")
        parts.append("+".join(reversed(pairs)))
    return ",".join(reversed(parts))


def _time(tag: int, raw: bytes) -> datetime:
    text = raw.decode("ascii", "replace")
    if tag == 23 and len(text) == 13:
        text = ("20" if text[:2] < "50" else "19") + text
    elif tag != 24 or len(text) != 15:
        raise BadDer
    if not text[:-1].isdigit() or text[-1] != "Z":
        raise BadDer
    try:
        return datetime.strptime(text, "%Y%m%d%H%M%SZ")
    except ValueError:
        raise BadDer from None


def _bits(raw: bytes) -> list[int]:
    if not raw or raw[0] > 7:
        raise BadDer
    return [i for i in range(8 * (len(raw) - 1) - raw[0]) if raw[1 + i // 8] >> (7 - i % 8) & 1]


def _urls(general_names: Der) -> list[str]:
    out = []
    while general_names.more():
        tag, raw, _ = general_names.next()
        if tag == 0x86:
            out.append(raw.decode("latin-1"))
    return out


def _extension(kind: str, der: Der, out: dict) -> None:
    if kind == "2.5.29.17":
        names = der.inside()
        dns, ips = [], []
        while names.more():
            tag, raw, _ = names.next()
            if tag == 0x82:
                dns.append(raw.decode("latin-1"))
            elif tag == 0x87:
                if len(raw) not in (4, 16):
                    raise BadDer
                ips.append(str(ipaddress.ip_address(raw)))
        out["san_dns"], out["san_ip"] = dns, ips
    elif kind == "2.5.29.19":
        body = der.inside()
        out["is_ca"] = False
        if body.peek() == BOOLEAN:
            out["is_ca"] = body.next()[1] != b"\0"
        if body.more():
            out["path_length"] = int.from_bytes(body.next(INTEGER)[1], "big")
    elif kind == "2.5.29.15":
        out["key_usage"] = [USAGES[i] for i in _bits(der.next(BITS)[1]) if i < len(USAGES)]
    elif kind in ("2.5.29.37", "2.5.29.32"):
        body, found = der.inside(), []
        while body.more():
            if kind == "2.5.29.37":
                o = oid(body.next(OID)[1])
                found.append(PURPOSES.get(o, o))
            else:
                found.append(oid(body.inside().next(OID)[1]))
        out["extended_key_usage" if kind == "2.5.29.37" else "policies"] = found
    elif kind == "2.5.29.14":
        out["subject_key_id"] = der.next(OCTETS)[1].hex()
    elif kind == "2.5.29.35":
        body = der.inside()
        if body.peek() == 0x80:
            out["authority_key_id"] = body.next()[1].hex()
    elif kind == "1.3.6.1.5.5.7.1.1":
        body, ocsp, issuers = der.inside(), [], []
        while body.more():
            one = body.inside()
            method = oid(one.next(OID)[1])
            tag, raw, _ = one.next()
            if tag == 0x86 and method in ("1.3.6.1.5.5.7.48.1", "1.3.6.1.5.5.7.48.2"):
                (ocsp if method.endswith(".1") else issuers).append(raw.decode("latin-1"))
        out["ocsp_urls"], out["ca_issuers_urls"] = ocsp, issuers
    elif kind == "2.5.29.31":
        body, urls = der.inside(), []
        while body.more():
            point = body.inside()
            if point.peek() == 0xA0:
                where = Der(point.next()[1])
                if where.peek() == 0xA0:
                    urls += _urls(Der(where.next()[1]))
        out["crl_urls"] = urls


FIELDS = [f.split(":")[0] for f in TYPE[7:-1].split(",")]


def parse(raw: bytes) -> dict | None:
    """Fields of a certificate, or None if its encoding is broken. The licence-bound fingerprints stay null."""
    out = dict.fromkeys(FIELDS)
    try:
        outer = Der(raw)
        cert = outer.inside()
        if outer.more():
            raise BadDer
        body = cert.inside()
        out["signature_algorithm"] = _algorithm(cert.inside())
        if body.peek() == 0xA0:
            body.next()
        out["serial"] = body.next(INTEGER)[1].hex()
        body.next(SEQUENCE)
        out["issuer"] = name(body.inside())
        dates = body.inside()
        out["not_before"], out["not_after"] = (_time(*dates.next()[:2]) for _ in range(2))
        out["subject"] = name(body.inside())
        _public_key(body.inside(), out)
        while body.more():
            tag, rest, _ = body.next()
            if tag == 0xA3:
                extensions = Der(rest).inside()
                while extensions.more():
                    one = extensions.inside()
                    kind = oid(one.next(OID)[1])
                    if one.peek() == BOOLEAN:
                        one.next()
                    _extension(kind, Der(one.next(OCTETS)[1]), out)
    except (BadDer, IndexError):
        return None
    out["sha1"], out["sha256"] = hashlib.sha1(raw).hexdigest(), hashlib.sha256(raw).hexdigest()
    return out


def _algorithm(der: Der) -> str:
    o = oid(der.next(OID)[1])
    return ALGORITHMS.get(o, o)


def _public_key(der: Der, out: dict) -> None:
    kind = der.inside()
    o = oid(kind.next(OID)[1])
    out["public_key_algorithm"] = algorithm = ALGORITHMS.get(o, o)
    key = der.next(BITS)[1][1:]
    if algorithm in ("rsaEncryption", "rsassaPss"):
        out["public_key_bits"] = int.from_bytes(Der(key).inside().next(INTEGER)[1], "big").bit_length()
    elif algorithm == "id-ecPublicKey" and kind.peek() == OID:
        curve = oid(kind.next()[1])
        out["public_key_curve"], out["public_key_bits"] = CURVES.get(curve, (curve, None))
    elif algorithm in KEY_BITS:
        out["public_key_bits"] = KEY_BITS[algorithm]
