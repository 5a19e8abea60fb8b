"""Scalar functions as column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def round_up(x: Column, to: int) -> Column:
    """The least multiple of `to` that is not below x."""
    return F.floor((x + to - 1) / to) * to


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves 1 or more, one decimal beyond bytes."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1:], 1):
        scaled = F.round(n.cast("double") / 1024**k, 1)
        out = F.when(n >= 1024**k, F.concat(scaled.cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of 64M, 1.5G, 0x200 or 512; null for anything else."""
    hexa = F.regexp_extract(text, r"(?i)^0x([0-9a-f]{1,15})$", 1)
    number = F.regexp_extract(text, r"(?i)^([0-9]+(?:\.[0-9]+)?)([kmgtp]?)(?:i?b)?$", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)^([0-9]+(?:\.[0-9]+)?)([kmgtp]?)(?:i?b)?$", 2))
    factor = F.lit(1).cast("decimal(20,0)")
    for k, letter in enumerate("kmgtp", 1):
        factor = F.when(unit == letter, F.lit(1024**k).cast("decimal(20,0)")).otherwise(factor)
    plain = F.when(number != "", F.floor(F.when(number != "", number).cast("decimal(18,3)") * factor).cast("long"))
    return F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).otherwise(plain)


def parent_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def glob(path: Column, pattern: str) -> Column:
    """The path equals the pattern, lies below it, or matches it as a case-sensitive glob in which * crosses slashes."""
    base = pattern.rstrip("/")
    matched = (path == base) | F.startswith(path, F.lit(base + "/"))
    if re.search(r"[*?\[]", pattern):
        inner = fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
        matched = matched | path.rlike(f"^(?s:{inner})$")
    return matched


def contains_text(text: Column, part: str) -> Column:
    """Case-insensitive search for the part as it stands: wildcards in it are letters."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def safe_name(name: Column) -> Column:
    """Names that any file system takes: control and reserved characters, a trailing dot or blank as %XX."""
    escaped = F.regexp_replace(name, "%", "%25")
    for c in '<>:"/\\|?*':
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    escaped = F.regexp_replace(escaped, r"\.$", "%2E")
    return F.regexp_replace(escaped, " $", "%20")


def file_mode(mode: Column, kind: Column) -> Column:
    """A mode as ls -l prints it (without set-id letters)."""
    out = F.when(kind == "dir", "d").when(kind == "symlink", "l").otherwise("-")
    parts = [out]
    for shift in (6, 3, 0):
        for bit, letter in ((4, "r"), (2, "w"), (1, "x")):
            parts.append(F.when(F.shiftright(mode, shift).bitwiseAND(F.lit(bit)) != 0, letter).otherwise("-"))
    return F.concat(*parts)


def bit_field(word: Column, low: int, bits: int) -> Column:
    """Bits low .. low+bits-1 of a 64-bit word."""
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << bits) - 1))


def all_zero(data: Column) -> Column:
    """Whether a binary column holds zero bytes only."""
    return F.length(F.replace(F.hex(data), F.lit("00"), F.lit(""))) == 0


def human_seconds(seconds: Column) -> Column:
    """1h05m, 2m07s or 9s; ? where it is not known."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m"))
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s"))
    return F.when(s.isNull(), "?").when(s >= 3600, hours).when(s >= 60, minutes).otherwise(F.concat(s.cast("string"), F.lit("s")))


def human_rate(rate: Column, unit: Column) -> Column:
    """Bytes a second in MB/s, other units as they are."""
    r = F.coalesce(rate, F.lit(0.0))
    return F.when(unit == "bytes", F.concat(F.rint(r / 1e6).cast("long").cast("string"), F.lit(" MB/s"))).otherwise(F.concat(F.rint(r).cast("long").cast("string"), F.lit(" "), unit, F.lit("/s")))


def destination(text: Column) -> Column:
    """(host, path) of "host:path"; host is null for local paths, an empty remote path is "."."""
    local = text.rlike(r"^([A-Za-z]:[\\/]|[/.~\\])")
    host = F.regexp_extract(text, r"^([^:/\\\s]+):(.*)$", 1)
    path = F.regexp_extract(text, r"^([^:/\\\s]+):(.*)$", 2)
    remote = ~local & (host != "")
    return F.struct(F.when(remote, host).alias("host"), F.when(remote, F.when(path == "", ".").otherwise(path)).otherwise(text).alias("path"))


#: Names of block types by code (fixed values of the on-disk format).
BLOCK_TYPES = (
    "NONE OBJECT_DIRECTORY OBJECT_ARRAY PACKED_NVLIST PACKED_NVLIST_SIZE BPOBJ BPOBJ_HDR SPACE_MAP_HEADER SPACE_MAP INTENT_LOG DNODE OBJSET DSL_DIR "
    "DSL_DIR_CHILD_MAP DSL_DS_SNAP_MAP DSL_PROPS DSL_DATASET ZNODE OLDACL PLAIN_FILE_CONTENTS DIRECTORY_CONTENTS MASTER_NODE UNLINKED_SET ZVOL ZVOL_PROP "
    "PLAIN_OTHER UINT64_OTHER ZAP_OTHER ERROR_LOG SPA_HISTORY SPA_HISTORY_OFFSETS POOL_PROPS DSL_PERMS ACL SYSACL FUID FUID_SIZE NEXT_CLONES SCAN_QUEUE "
    "USERGROUP_USED USERGROUP_QUOTA USERREFS DDT_ZAP DDT_STATS SA SA_MASTER_NODE SA_ATTR_REGISTRATION SA_ATTR_LAYOUTS SCAN_XLATE DEDUP DEADLIST "
    "DEADLIST_HDR DSL_CLONES BPOBJ_SUBOBJ"
).split()


def block_type(code: Column) -> Column:
    """The name of a block type: newtype(n,meta,enc) for codes with bit 7, typeN for unknown ones."""
    bit = lambda b: code.bitwiseAND(F.lit(b)) != 0
    flags = F.concat_ws(",", code.bitwiseAND(F.lit(31)).cast("string"), F.when(bit(64), "meta"), F.when(bit(32), "enc"))
    known = F.try_element_at(F.array(*map(F.lit, BLOCK_TYPES)), (code + 1).cast("int"))
    return F.when(bit(128), F.concat(F.lit("newtype("), flags, F.lit(")"))).otherwise(F.coalesce(known, F.concat(F.lit("type"), code.cast("string"))))


def block_type_valid(code: Column) -> Column:
    return (code < len(BLOCK_TYPES)) | ((code.bitwiseAND(F.lit(128)) != 0) & (code.bitwiseAND(F.lit(31)) <= 9))
