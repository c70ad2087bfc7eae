"""Checksums, digests, ciphers, random values and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import BINARY, BOOL, FLOAT, INT, STRING, Kind, Typed, const, first_error

from .codecs import as_bytes, raw
from .convert import fail
from .registry import arrow, fn, need_const


@fn("md5", "value:str")
def md5(ctx, value: Typed):
    return Typed(STRING, F.md5(raw(value)), value.err)


@fn("sha1", "value:str")
def sha1(ctx, value: Typed):
    return Typed(STRING, F.sha1(raw(value)), value.err)


def digest(name: str):
    def run(b):
        import hashlib

        return hashlib.new(name, bytes(b)).hexdigest()

    return run


@fn("sha2", "value:str, variant?:str=SHA-512/256")
def sha2(ctx, value: Typed, variant: Typed):
    name = need_const(variant, "variant")
    if name in ("SHA-224", "SHA-256", "SHA-384", "SHA-512"):
        return Typed(STRING, F.sha2(raw(value), int(name[4:])), value.err)
    if name not in ("SHA-512/224", "SHA-512/256"):
        raise CompileError(403, f"invalid enum variant: {name}")
    return arrow(digest("sha512_" + name[-3:]), STRING, as_bytes(value)).with_err(value.err)


@fn("sha3", "value:str, variant?:str=SHA3-512")
def sha3(ctx, value: Typed, variant: Typed):
    name = need_const(variant, "variant")
    if name not in ("SHA3-224", "SHA3-256", "SHA3-384", "SHA3-512"):
        raise CompileError(403, f"invalid enum variant: {name}")
    return arrow(digest("sha3_" + name[-3:]), STRING, as_bytes(value)).with_err(value.err)


@fn("hmac", "value:str, key:str, algorithm?:str=SHA-256")
def hmac(ctx, value: Typed, key: Typed, algorithm: Typed):
    name = {"SHA1": "sha1", "SHA-224": "sha224", "SHA-256": "sha256", "SHA-384": "sha384", "SHA-512": "sha512"}.get(need_const(algorithm, "algorithm"))
    if name is None:
        raise CompileError(403, f"invalid enum variant: {algorithm.const}")

    def run(v, k):
        import hmac as h

        return h.new(bytes(k), bytes(v), name).digest()

    return arrow(run, BINARY, as_bytes(value), as_bytes(key)).with_err(value.err)


# Parameters of checksums by name: width, polynomial, start, reflected in, reflected out, final xor.
CRCS = {
    "CRC_8_SMBUS": (8, 0x07, 0x00, False, False, 0x00), "CRC_8_MAXIM_DOW": (8, 0x31, 0x00, True, True, 0x00), "CRC_8_AUTOSAR": (8, 0x2F, 0xFF, False, False, 0xFF), "CRC_8_BLUETOOTH": (8, 0xA7, 0x00, True, True, 0x00), "CRC_8_CDMA2000": (8, 0x9B, 0xFF, False, False, 0x00), "CRC_8_DARC": (8, 0x39, 0x00, True, True, 0x00), "CRC_8_DVB_S2": (8, 0xD5, 0x00, False, False, 0x00), "CRC_8_I_432_1": (8, 0x07, 0x00, False, False, 0x55), "CRC_8_ROHC": (8, 0x07, 0xFF, True, True, 0x00), "CRC_8_WCDMA": (8, 0x9B, 0x00, True, True, 0x00),
    "CRC_16_ARC": (16, 0x8005, 0x0000, True, True, 0x0000), "CRC_16_CMS": (16, 0x8005, 0xFFFF, False, False, 0x0000), "CRC_16_DNP": (16, 0x3D65, 0x0000, True, True, 0xFFFF), "CRC_16_GSM": (16, 0x1021, 0x0000, False, False, 0xFFFF), "CRC_16_IBM_3740": (16, 0x1021, 0xFFFF, False, False, 0x0000), "CRC_16_IBM_SDLC": (16, 0x1021, 0xFFFF, True, True, 0xFFFF), "CRC_16_KERMIT": (16, 0x1021, 0x0000, True, True, 0x0000), "CRC_16_MAXIM_DOW": (16, 0x8005, 0x0000, True, True, 0xFFFF), "CRC_16_MCRF4XX": (16, 0x1021, 0xFFFF, True, True, 0x0000), "CRC_16_MODBUS": (16, 0x8005, 0xFFFF, True, True, 0x0000), "CRC_16_SPI_FUJITSU": (16, 0x1021, 0x1D0F, False, False, 0x0000), "CRC_16_UMTS": (16, 0x8005, 0x0000, False, False, 0x0000), "CRC_16_USB": (16, 0x8005, 0xFFFF, True, True, 0xFFFF), "CRC_16_XMODEM": (16, 0x1021, 0x0000, False, False, 0x0000), "CRC_16_GENIBUS": (16, 0x1021, 0xFFFF, False, False, 0xFFFF), "CRC_16_T10_DIF": (16, 0x8BB7, 0x0000, False, False, 0x0000),
    "CRC_24_OPENPGP": (24, 0x864CFB, 0xB704CE, False, False, 0x000000), "CRC_24_BLE": (24, 0x00065B, 0x555555, True, True, 0x000000),
    "CRC_32_ISO_HDLC": (32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0xFFFFFFFF), "CRC_32_BZIP2": (32, 0x04C11DB7, 0xFFFFFFFF, False, False, 0xFFFFFFFF), "CRC_32_ISCSI": (32, 0x1EDC6F41, 0xFFFFFFFF, True, True, 0xFFFFFFFF), "CRC_32_CKSUM": (32, 0x04C11DB7, 0x00000000, False, False, 0xFFFFFFFF), "CRC_32_MPEG_2": (32, 0x04C11DB7, 0xFFFFFFFF, False, False, 0x00000000), "CRC_32_JAMCRC": (32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0x00000000), "CRC_32_XFER": (32, 0x000000AF, 0x00000000, False, False, 0x00000000), "CRC_32_AIXM": (32, 0x814141AB, 0x00000000, False, False, 0x00000000), "CRC_32_AUTOSAR": (32, 0xF4ACFB13, 0xFFFFFFFF, True, True, 0xFFFFFFFF),
    "CRC_64_ECMA_182": (64, 0x42F0E1EBA9EA3693, 0, False, False, 0), "CRC_64_GO_ISO": (64, 0x000000000000001B, 0xFFFFFFFFFFFFFFFF, True, True, 0xFFFFFFFFFFFFFFFF), "CRC_64_WE": (64, 0x42F0E1EBA9EA3693, 0xFFFFFFFFFFFFFFFF, False, False, 0xFFFFFFFFFFFFFFFF), "CRC_64_XZ": (64, 0x42F0E1EBA9EA3693, 0xFFFFFFFFFFFFFFFF, True, True, 0xFFFFFFFFFFFFFFFF),
}


def mirrored(n: int, width: int) -> int:
    return int(f"{n:0{width}b}"[::-1], 2)


def crc_of(data: bytes, width: int, poly: int, init: int, refin: bool, refout: bool, xorout: int) -> int:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        table.append(r)
    flip = [mirrored(b, 8) for b in range(256)]
    r = init
    for b in data:
        r = (r << 8 ^ table[(r >> (width - 8) ^ (flip[b] if refin else b)) & 255]) & mask
    return (mirrored(r, width) if refout else r) ^ xorout


@fn("crc", "value:str, algorithm?:str=CRC_32_ISO_HDLC")
def crc(ctx, value: Typed, algorithm: Typed):
    name = need_const(algorithm, "algorithm")
    if name not in CRCS:
        return Typed(STRING, F.lit(None).cast("string"), F.lit("Invalid CRC algorithm"))
    if name == "CRC_32_ISO_HDLC":
        return Typed(STRING, F.crc32(raw(value)).cast("string"), F.when(F.lit(False), F.lit("")))
    return arrow(lambda b: str(crc_of(bytes(b), *CRCS[name])), STRING, as_bytes(value))


@fn("xxhash", "value:str, variant?:str=XXH32")
def xxhash(ctx, value: Typed, variant: Typed):
    name = need_const(variant, "variant")
    if name not in ("XXH32", "XXH64", "XXH3-64", "XXH3-128"):
        raise CompileError(403, f"invalid enum variant: {name}")

    def run(b):
        import xxhash as x

        n = {"XXH32": x.xxh32_intdigest, "XXH64": x.xxh64_intdigest, "XXH3-64": x.xxh3_64_intdigest, "XXH3-128": x.xxh3_128_intdigest}[name](bytes(b))
        return str(n) if name == "XXH3-128" else n - (1 << 64) if n >= 1 << 63 else n

    return arrow(run, STRING if name == "XXH3-128" else INT, as_bytes(value)).with_err(value.err)


def sea(data: bytes) -> int:
    m = (1 << 64) - 1

    def diffuse(x):
        x = x * 0x6EED0E9DA4D94A4F & m
        x ^= (x >> 32) >> (x >> 60)
        return x * 0x6EED0E9DA4D94A4F & m

    a = [0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381]
    for i in range(0, len(data), 8):
        a = [a[1], a[2], a[3], diffuse(a[0] ^ int.from_bytes(data[i : i + 8], "little"))]
    n = diffuse(a[0] ^ a[1] ^ a[2] ^ a[3] ^ len(data))
    return n - (1 << 64) if n >= 1 << 63 else n


@fn("seahash", "value:str")
def seahash(ctx, value: Typed):
    return arrow(lambda b: sea(bytes(b)), INT, as_bytes(value)).with_err(value.err)


def rotl(x, n):
    return (x << n | x >> (32 - n)) & 0xFFFFFFFF


def quarter(s, a, b, c, d):
    s[a] = (s[a] + s[b]) & 0xFFFFFFFF
    s[d] = rotl(s[d] ^ s[a], 16)
    s[c] = (s[c] + s[d]) & 0xFFFFFFFF
    s[b] = rotl(s[b] ^ s[c], 12)
    s[a] = (s[a] + s[b]) & 0xFFFFFFFF
    s[d] = rotl(s[d] ^ s[a], 8)
    s[c] = (s[c] + s[d]) & 0xFFFFFFFF
    s[b] = rotl(s[b] ^ s[c], 7)


def chacha_block(key: bytes, counter: int, nonce: bytes, final: bool = True) -> bytes:
    """A ChaCha20 block; without the final addition, the subkey of the extended-nonce form."""
    words = [0x61707865, 0x3320646E, 0x79622D32, 0x6B206574, *(int.from_bytes(key[i : i + 4], "little") for i in range(0, 32, 4))]
    words += [counter, *(int.from_bytes(nonce[i : i + 4], "little") for i in range(0, 12, 4))] if final else [int.from_bytes(nonce[i : i + 4], "little") for i in range(0, 16, 4)]
    s = list(words)
    for _ in range(10):
        for q in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            quarter(s, *q)
    if final:
        return b"".join(((a + b) & 0xFFFFFFFF).to_bytes(4, "little") for a, b in zip(s, words, strict=True))
    return b"".join(x.to_bytes(4, "little") for x in s[:4] + s[12:])


def chacha_stream(key, nonce, data, counter=1):
    out = bytearray()
    for i in range(0, len(data), 64):
        out += bytes(a ^ b for a, b in zip(data[i : i + 64], chacha_block(key, counter + i // 64, nonce), strict=False))
    return bytes(out)


def poly1305(key: bytes, data: bytes) -> bytes:
    r, s, acc, p = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(key[16:], "little"), 0, (1 << 130) - 5
    for i in range(0, len(data), 16):
        acc = (acc + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % p
    return ((acc + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def chacha_poly(key, nonce, data, seal: bool) -> bytes:
    tag_key = chacha_block(key, 0, nonce)[:32]
    body = data if seal else data[:-16]
    cipher = chacha_stream(key, nonce, body) if seal else body
    tag = poly1305(tag_key, cipher + b"\0" * (-len(cipher) % 16) + (0).to_bytes(8, "little") + len(cipher).to_bytes(8, "little"))
    if seal:
        return cipher + tag
    if tag != data[-16:]:
        raise ValueError("unable to decrypt value: wrong tag")
    return chacha_stream(key, nonce, body)


class AES:
    """The block cipher, for modes and formats that have no built-in."""

    _sbox: list[int] = []

    def __init__(self, key: bytes):
        if not AES._sbox:
            p = q = 1
            box = [0] * 256
            while True:
                p = p ^ (p << 1 & 0xFF) ^ (0x1B if p & 0x80 else 0)
                q ^= q << 1
                q ^= q << 2
                q ^= q << 4
                q &= 0xFF
                if q & 0x80:
                    q ^= 0x09
                x = q ^ (q << 1 | q >> 7) ^ (q << 2 | q >> 6) ^ (q << 3 | q >> 5) ^ (q << 4 | q >> 4)
                box[p] = (x ^ 0x63) & 0xFF
                if p == 1:
                    break
            box[0] = 0x63
            AES._sbox = box
        n = len(key) // 4
        w = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        rcon = 1
        for i in range(n, 4 * (n + 7)):
            t = list(w[-1])
            if i % n == 0:
                t = [self._sbox[x] for x in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
            elif n > 6 and i % n == 4:
                t = [self._sbox[x] for x in t]
            w.append([a ^ b for a, b in zip(w[i - n], t, strict=True)])
        self.round_keys = [sum(w[i : i + 4], []) for i in range(0, len(w), 4)]

    @staticmethod
    def _mul(a, b):
        out = 0
        while b:
            if b & 1:
                out ^= a
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.round_keys[0], strict=True)]
        for k in self.round_keys[1:]:
            s = [self._sbox[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if k is not self.round_keys[-1]:
                s = [self._mul(s[4 * c + r], 2) ^ self._mul(s[4 * c + (r + 1) % 4], 3) ^ s[4 * c + (r + 2) % 4] ^ s[4 * c + (r + 3) % 4] for c in range(4) for r in range(4)]
            s = [a ^ b for a, b in zip(s, k, strict=True)]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        inverse = [0] * 256
        for i, x in enumerate(self._sbox):
            inverse[x] = i
        s = [a ^ b for a, b in zip(block, self.round_keys[-1], strict=True)]
        for k in self.round_keys[-2::-1]:
            s = [inverse[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, k, strict=True)]
            if k is not self.round_keys[0]:
                s = [self._mul(s[4 * c + r], 14) ^ self._mul(s[4 * c + (r + 1) % 4], 11) ^ self._mul(s[4 * c + (r + 2) % 4], 13) ^ self._mul(s[4 * c + (r + 3) % 4], 9) for c in range(4) for r in range(4)]
        return bytes(s)


def xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=False))


def padded(data: bytes, how: str) -> bytes:
    n = 16 - len(data) % 16
    tail = {"PKCS7": bytes([n]) * n, "ANSIX923": b"\0" * (n - 1) + bytes([n]), "ISO7816": b"\x80" + b"\0" * (n - 1), "ISO10126": b"\0" * (n - 1) + bytes([n])}[how]
    return data + tail


def unpadded(data: bytes, how: str) -> bytes:
    if how == "ISO7816":
        bare = data.rstrip(b"\0")
        if bare[-1:] != b"\x80":
            raise ValueError("Invalid input")
        return bare[:-1]
    n = data[-1]
    if not 1 <= n <= 16:
        raise ValueError("Invalid input")
    return data[:-n]


def cmac(aes: AES, data: bytes) -> bytes:
    def double(b):
        n = int.from_bytes(b, "big") << 1
        return ((n ^ 0x87 if n >> 128 else n) & ((1 << 128) - 1)).to_bytes(16, "big")

    k1 = double(aes.encrypt(b"\0" * 16))
    blocks = [data[i : i + 16] for i in range(0, len(data), 16)] or [b""]
    last = xor(blocks[-1], k1) if len(blocks[-1]) == 16 else xor((blocks[-1] + b"\x80").ljust(16, b"\0"), double(k1))
    x = b"\0" * 16
    for b in [*blocks[:-1], last]:
        x = aes.encrypt(xor(x, b))
    return x


def s2v(aes: AES, parts: list[bytes]) -> bytes:
    def double(b):
        n = int.from_bytes(b, "big") << 1
        return ((n ^ 0x87 if n >> 128 else n) & ((1 << 128) - 1)).to_bytes(16, "big")

    d = cmac(aes, b"\0" * 16)
    for p in parts[:-1]:
        d = xor(double(d), cmac(aes, p))
    last = parts[-1]
    t = last[:-16] + xor(last[-16:], d) if len(last) >= 16 else xor(double(d), (last + b"\x80").ljust(16, b"\0"))
    return cmac(aes, t)


def counter_mode(aes: AES, start: bytes, data: bytes, order: str = "big") -> bytes:
    n, out = int.from_bytes(start, order), bytearray()
    for i in range(0, len(data), 16):
        out += xor(data[i : i + 16], aes.encrypt(((n + i // 16) & ((1 << 128) - 1)).to_bytes(16, order)))
    return bytes(out)


def salsa_core(words: list[int], final: bool) -> list[int]:
    s = list(words)

    def qr(a, b, c, d):
        s[b] ^= rotl((s[a] + s[d]) & 0xFFFFFFFF, 7)
        s[c] ^= rotl((s[b] + s[a]) & 0xFFFFFFFF, 9)
        s[d] ^= rotl((s[c] + s[b]) & 0xFFFFFFFF, 13)
        s[a] ^= rotl((s[d] + s[c]) & 0xFFFFFFFF, 18)

    for _ in range(10):
        for q in ((0, 4, 8, 12), (5, 9, 13, 1), (10, 14, 2, 6), (15, 3, 7, 11), (0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14)):
            qr(*q)
    return [(a + b) & 0xFFFFFFFF for a, b in zip(s, words, strict=True)] if final else s


def xsalsa_poly(key: bytes, nonce: bytes, data: bytes, seal: bool) -> bytes:
    u = lambda b: [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]
    c = u(b"expand 32-byte k")
    lay = lambda k, n: [c[0], *k[:4], c[1], *n, c[2], *k[4:], c[3]]
    z = salsa_core(lay(u(key), u(nonce[:16])), False)
    sub = [z[i] for i in (0, 5, 10, 15, 6, 7, 8, 9)]

    def stream(n):
        out = bytearray()
        for i in range(0, n + 64, 64):
            out += b"".join(x.to_bytes(4, "little") for x in salsa_core(lay(sub, [*u(nonce[16:24]), i // 64 & 0xFFFFFFFF, 0]), True))
        return bytes(out)

    body = data if seal else data[16:]
    ks = stream(len(body) + 32)
    text = xor(body, ks[32 : 32 + len(body)])
    tag = poly1305(ks[:32], text if seal else body)
    if seal:
        return tag + text
    if tag != data[:16]:
        raise ValueError("unable to decrypt value: wrong tag")
    return text


def sizes_of(name: str) -> tuple[int, int] | None:
    """Bytes of key and iv of a cipher; None if there is no such cipher."""
    import re

    if m := re.fullmatch(r"AES-(128|192|256)-(CFB|OFB|CTR|CTR-LE|CTR-BE|CBC-(?:PKCS7|ANSIX923|ISO7816|ISO10126))", name):
        return int(m[1]) // 8, 16
    return {"AES-128-SIV": (32, 16), "AES-256-SIV": (64, 16), "CHACHA20-POLY1305": (32, 12), "XCHACHA20-POLY1305": (32, 24), "XSALSA20-POLY1305": (32, 24)}.get(name)


def crypt(data: bytes, name: str, key: bytes, iv: bytes, seal: bool) -> bytes:
    sizes = sizes_of(name)
    if sizes is None:
        raise ValueError(f"Invalid algorithm: {name}")
    if len(key) != sizes[0]:
        raise ValueError(f'Invalid key length. The key length must be {sizes[0]} bytes')
    if len(iv) != sizes[1]:
        raise ValueError(f'Invalid iv length. The iv length must be {sizes[1]} bytes')
    if name == "CHACHA20-POLY1305":
        return chacha_poly(key, iv, data, seal)
    if name == "XCHACHA20-POLY1305":
        return chacha_poly(chacha_block(key, 0, iv[:16], final=False), b"\0" * 4 + iv[16:], data, seal)
    if name == "XSALSA20-POLY1305":
        return xsalsa_poly(key, iv, data, seal)
    if name.endswith("SIV"):
        half = len(key) // 2
        mac, enc = AES(key[:half]), AES(key[half:])
        start = lambda v: (int.from_bytes(v, "big") & ~((1 << 63) | (1 << 31))).to_bytes(16, "big")
        if seal:
            v = s2v(mac, [iv, data])
            return v + counter_mode(enc, start(v), data)
        v = data[:16]
        text = counter_mode(enc, start(v), data[16:])
        if s2v(mac, [iv, text]) != v:
            raise ValueError("unable to decrypt value: wrong tag")
        return text
    aes, mode = AES(key), name.split("-", 2)[2]
    if mode.startswith("CTR"):
        return counter_mode(aes, iv, data, "little" if mode == "CTR-LE" else "big")
    if mode.startswith("CBC"):
        how, out, last = mode[4:], b"", iv
        if seal:
            data = padded(data, how)
            for i in range(0, len(data), 16):
                last = aes.encrypt(xor(data[i : i + 16], last))
                out += last
            return out
        if len(data) % 16 or not data:
            raise ValueError("Invalid input")
        for i in range(0, len(data), 16):
            out += xor(aes.decrypt(data[i : i + 16]), last)
            last = data[i : i + 16]
        return unpadded(out, how)
    out, last = b"", iv
    for i in range(0, len(data), 16):
        ks = aes.encrypt(last)
        new = xor(data[i : i + 16], ks)
        last = ks if mode == "OFB" else (new if seal else data[i : i + 16])
        out += new
    return out


def boxes() -> tuple:
    """AES as numpy tables: S-box and its inverse, and by row of a column what a byte of it adds to the mixed column, both ways, as 32-bit words."""
    import numpy as np

    AES(bytes(16))
    box = np.array(AES._sbox, dtype=np.uint8)
    inverse = np.argsort(box).astype(np.uint8)

    def mixed(values, factors) -> list:
        rows = np.array([[AES._mul(int(x), f) for f in factors] for x in values], dtype=np.uint8)
        return [np.ascontiguousarray(np.roll(rows, r, axis=1)).view(np.uint32).ravel() for r in range(4)]

    return box, inverse, mixed(box, (2, 1, 1, 3)), mixed(range(256), (14, 9, 13, 11))


class ManyAES:
    """The block cipher over arrays of blocks, each with one of the keys, all of one length."""

    _boxes: tuple = ()

    def __init__(self, keys: list[bytes]):
        import numpy as np

        ManyAES._boxes = ManyAES._boxes or boxes()
        box = self._boxes[0]
        size = len(keys[0])
        n = size // 4
        given = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, n, 4)
        w = np.empty((len(keys), 4 * (n + 7), 4), dtype=np.uint8)
        w[:, :n] = given
        rcon = 1
        for i in range(n, 4 * (n + 7)):
            t = w[:, i - 1]
            if i % n == 0:
                t = box[np.roll(t, -1, axis=1)]
                t[:, 0] ^= rcon
                rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
            elif n > 6 and i % n == 4:
                t = box[t]
            w[:, i] = w[:, i - n] ^ t
        self.words = np.ascontiguousarray(w).view(np.uint32).reshape(len(keys), n + 7, 4).transpose(1, 0, 2)

    def _run(self, blocks, key, back: bool):
        import numpy as np

        box, inverse, there, home = self._boxes
        table, step = (inverse, -1) if back else (box, 1)
        places = [(np.arange(4) + step * r) % 4 for r in range(4)]
        words = self.words[::-1] if back else self.words
        k = lambda i: words[i] if len(words[i]) == 1 else words[i][key]
        mix = lambda s, tables: tables[0][s[:, :, 0]] ^ tables[1][s[:, :, 1]] ^ tables[2][s[:, :, 2]] ^ tables[3][s[:, :, 3]]
        moved = lambda s: np.stack([s[:, places[r], r] for r in range(4)], axis=2)
        cells = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4, 4)
        x = np.ascontiguousarray(blocks).view(np.uint32) ^ k(0)
        for i in range(1, len(words) - 1):
            s = moved(cells(x))
            x = mix(cells(cells(inverse[s]) ^ cells(np.broadcast_to(k(i), x.shape))), home) if back else mix(s, there) ^ k(i)
        x = cells(table[moved(cells(x))]).view(np.uint32).reshape(-1, 4) ^ k(len(words) - 1)
        return x.view(np.uint8).reshape(-1, 16)

    def encrypt(self, blocks, key):
        return self._run(blocks, key, False)

    def decrypt(self, blocks, key):
        return self._run(blocks, key, True)


def many_aes(mode: str, rows: list[tuple], seal: bool) -> list:
    """Texts, keys and ivs of one AES mode: blocks that need one another's result in step over all rows, the others at once."""
    import numpy as np

    keys = {k: i for i, k in enumerate(dict.fromkeys(k for _, k, _ in rows))}
    aes = ManyAES(list(keys))
    data = [padded(d, mode[4:]) if seal and mode.startswith("CBC") else d for d, _, _ in rows]
    counts = np.array([-(-len(d) // 16) for d in data])
    starts = np.cumsum(counts) - counts
    blocks = np.frombuffer(b"".join([d.ljust(16 * n, b"\0") for d, n in zip(data, counts.tolist(), strict=True)]), dtype=np.uint8).reshape(-1, 16)
    key = np.array([keys[k] for _, k, _ in rows])
    ivs = np.frombuffer(b"".join([v for _, _, v in rows]), dtype=np.uint8).reshape(-1, 16)
    owner = np.repeat(np.arange(len(rows)), counts)
    if mode.startswith("CTR"):
        order = "little" if mode == "CTR-LE" else "big"
        at = (np.arange(len(blocks)) - starts[owner]).tolist()
        first = [int.from_bytes(v, order) for _, _, v in rows]
        wheel = b"".join([((first[o] + i) & ((1 << 128) - 1)).to_bytes(16, order) for o, i in zip(owner.tolist(), at, strict=True)])
        out = blocks ^ aes.encrypt(np.frombuffer(wheel, dtype=np.uint8).reshape(-1, 16), key[owner])
    elif not seal and mode != "OFB":
        before = np.roll(blocks, 1, axis=0)
        before[starts[counts > 0]] = ivs[counts > 0]
        out = before ^ aes.decrypt(blocks, key[owner]) if mode.startswith("CBC") else blocks ^ aes.encrypt(before, key[owner])
    else:
        out, longest, last = np.empty_like(blocks), np.argsort(-counts, kind="stable"), ivs.copy()
        left = np.searchsorted(-counts[longest], -np.arange(counts.max(initial=0)), side="left")
        for i, n in enumerate(left.tolist()):
            some = longest[:n]
            b = blocks[starts[some] + i]
            if mode.startswith("CBC"):
                new = last[some] = aes.encrypt(b ^ last[some], key[some])
            else:
                stream = aes.encrypt(last[some], key[some])
                new = b ^ stream
                last[some] = stream if mode == "OFB" else new
            out[starts[some] + i] = new
    raw = out.tobytes()
    texts = [raw[16 * a : 16 * a + len(d)] for a, d in zip(starts.tolist(), data, strict=True)]
    return texts if seal or not mode.startswith("CBC") else [attempt(unpadded, t, mode[4:]) for t in texts]


def attempt(f, *args):
    """f(*args), or the exception it raises."""
    try:
        return f(*args)
    except Exception as e:
        return e


def many_chacha(rows: list[tuple], seal: bool) -> list:
    """chacha_poly over texts, keys and nonces: the blocks of all rows at once."""
    import numpy as np

    body = [d if seal else d[:-16] for d, _, _ in rows]
    counts = np.array([1 + -(-len(b) // 64) for b in body])
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(rows)), counts)
    u = lambda parts: np.frombuffer(b"".join(parts), dtype="<u4").reshape(len(rows), -1)
    keys, nonces = u([k for _, k, _ in rows]), u([v for _, _, v in rows])
    words = np.empty((16, len(owner)), dtype=np.uint32)
    words[:4] = np.array([[0x61707865], [0x3320646E], [0x79622D32], [0x6B206574]], dtype=np.uint32)
    words[4:12], words[12], words[13:] = keys[owner].T, np.arange(len(owner)) - starts[owner], nonces[owner].T
    s = words.copy()

    def turn(a, b, c, d):
        for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            s[x] += s[y]
            t = s[z] ^ s[x]
            s[z] = t << np.uint32(n) | t >> np.uint32(32 - n)

    for _ in range(10):
        for q in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            turn(*q)
    stream = np.ascontiguousarray((s + words).T.astype("<u4")).tobytes()
    text = np.frombuffer(b"".join([bytes(64) + b.ljust(64 * (n - 1), b"\0") for b, n in zip(body, counts.tolist(), strict=True)]), dtype=np.uint8)
    mixed = (text ^ np.frombuffer(stream, dtype=np.uint8)).tobytes()
    out: list = []
    for (data, _, _), b, a in zip(rows, body, (64 * starts).tolist(), strict=True):
        new = mixed[a + 64 : a + 64 + len(b)]
        cipher = new if seal else b
        tag = poly1305(stream[a : a + 32], cipher + b"\0" * (-len(cipher) % 16) + bytes(8) + len(cipher).to_bytes(8, "little"))
        out.append(cipher + tag if seal else new if tag == data[-16:] else ValueError("unable to decrypt value: wrong tag"))
    return out


def crypt_many(rows: list[tuple], seal: bool) -> list:
    """crypt() of each row, or the exception it raises; rows of one cipher together."""
    out: list = [None] * len(rows)
    groups: dict[str, list[int]] = {}
    for i, (data, name, key, iv) in enumerate(rows):
        mode = name.split("-", 2)[2] if name.startswith("AES-") and name.count("-") > 1 else name
        plain = sizes_of(name) != (len(key), len(iv)) or mode == "SIV" or name == "XSALSA20-POLY1305"
        if plain or mode.startswith("CBC") and not seal and (len(data) % 16 or not data):
            out[i] = attempt(crypt, data, name, key, iv, seal)
        else:
            groups.setdefault(name, []).append(i)
    for name, at in groups.items():
        some = [(rows[i][0], rows[i][2], rows[i][3]) for i in at]
        if name.startswith("AES"):
            got = many_aes(name.split("-", 2)[2], some, seal)
        else:
            if name[0] == "X":
                subkeys = {kv: chacha_block(kv[0], 0, kv[1], final=False) for kv in {(k, v[:16]) for _, k, v in some}}
                some = [(d, subkeys[k, v[:16]], bytes(4) + v[16:]) for d, k, v in some]
            got = many_chacha(some, seal)
        for i, x in zip(at, got, strict=True):
            out[i] = x
    return out


for _name, _value, _seal in (("encrypt", "plaintext", True), ("decrypt", "ciphertext", False)):

    def _make(name=_name, value=_value, seal=_seal):
        @fn(name, f"{value}:str, algorithm:str, key:str, iv:str")
        def lower(ctx, algorithm: Typed, key: Typed, iv: Typed, **args: Typed):
            if algorithm.is_const and sizes_of(algorithm.const) is None:
                raise CompileError(402, f"Invalid algorithm: {algorithm.const}")

            def many(rows):
                found = crypt_many([(bytes(b), a, bytes(k), bytes(v)) for b, a, k, v in rows], seal)
                return found if seal else [x if isinstance(x, Exception) else x.decode("utf-8", "replace") for x in found]

            return arrow(None, BINARY if seal else STRING, as_bytes(args[value]), algorithm, as_bytes(key), as_bytes(iv), many=many)

    _make()


@fn("random_bool", "")
def random_bool(ctx):
    return Typed(BOOL, F.rand() < 0.5, nullable=False)


@fn("random_float", "min:flt/int, max:flt/int")
def random_float(ctx, min: Typed, max: Typed):
    lo, hi = min.col.cast("double"), max.col.cast("double")
    return Typed(FLOAT, lo + F.rand() * (hi - lo), fail(hi <= lo, "max must be greater than min"))


@fn("random_int", "min:int, max:int")
def random_int(ctx, min: Typed, max: Typed):
    return Typed(INT, F.floor(min.col + F.rand() * (max.col - min.col)).cast("bigint"), fail(max.col <= min.col, "max must be greater than min"))


@fn("random_bytes", "length:int")
def random_bytes(ctx, length: Typed):
    def run(n, _):
        import os

        if not 0 <= n <= 65536:
            raise ValueError("Invalid length")
        return os.urandom(n)

    return arrow(run, BINARY, Typed(INT, length.column()), Typed(FLOAT, F.rand()))


@fn("uuid_v4", "")
def uuid_v4(ctx):
    return Typed(STRING, F.expr("uuid()"), nullable=False)


@fn("uuid_v7", "timestamp?:ts")
def uuid_v7(ctx, timestamp: Typed | None):
    at = F.unix_millis(timestamp.col if timestamp is not None else F.current_timestamp())
    head = F.lpad(F.lower(F.hex(at)), 12, "0")
    tail = F.substring(F.expr("uuid()"), 15, 22)  # the version's digits, the variant and the rest of a random identifier
    return Typed(STRING, F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(tail, 2, 21)))


@fn("uuid_from_friendly_id", "value:str")
def uuid_from_friendly_id(ctx, value: Typed):
    def run(v):
        import uuid

        n = 0
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
        for c in v:
            n = n * 62 + digits.index(c)
        return str(uuid.UUID(int=n))

    return arrow(run, STRING, value, error="failed to decode friendly id")
