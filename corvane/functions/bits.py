"""Bit fields of page numbers, record addresses and slots, and free-space classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_BITS, SLOT_BITS = 48, 16
PAGE_HEADER_BYTES = 12


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("long")


def segment_of(pid: Column) -> Column:
    """The 16-bit segment number of a page number."""
    return F.shiftrightunsigned(pid, PAGE_BITS)


def page_in_segment(pid: Column) -> Column:
    return pid.bitwiseAND(_mask(PAGE_BITS))


def page_number(segment: Column, page: Column) -> Column:
    return F.shiftleft(segment.cast("long"), PAGE_BITS).bitwiseXOR(page.bitwiseAND(_mask(PAGE_BITS)))


def pid_text(pid: Column) -> Column:
    """A page number in words."""
    return F.format_string("(segNr: %d, pageNr: %d)", segment_of(pid), page_in_segment(pid))


def tid(page: Column, slot: Column) -> Column:
    """A record's address: 48 bits of page, 16 bits of slot."""
    return F.shiftleft(page.cast("long"), SLOT_BITS).bitwiseXOR(slot.cast("long"))


def tid_page(address: Column) -> Column:
    return F.shiftrightunsigned(address, SLOT_BITS)


def tid_slot(address: Column) -> Column:
    return address.bitwiseAND(_mask(SLOT_BITS)).cast("int")


def tid_page_number(address: Column, segment: Column) -> Column:
    """The page number of an address inside a segment."""
    return page_number(segment, tid_page(address))


def slot(offset: Column, size: Column, target: Column | int = 0xFF, inner: Column | int = 0) -> Column:
    """A slot's 64 bits: T (8), S (8), offset (24), size (24)."""
    parts = [F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (target, inner, offset, size)]
    out = parts[0]
    for part, width in zip(parts[1:], (8, 24, 24), strict=True):
        out = F.shiftleft(out, width).bitwiseOR(part.bitwiseAND(_mask(width)))
    return out


def slot_fields(value: Column) -> dict[str, Column]:
    """``t``, ``s``, ``offset`` and ``size`` of a slot."""
    return {
        "t": F.shiftrightunsigned(value, 56),
        "s": F.shiftrightunsigned(value, 48).bitwiseAND(_mask(8)),
        "offset": F.shiftrightunsigned(value, 24).bitwiseAND(_mask(24)),
        "size": value.bitwiseAND(_mask(24)),
    }


def slot_flags(value: Column) -> dict[str, Column]:
    """``redirect`` (T is not 0xFF: the slot holds another record's address), ``redirected_to`` (S is set) and ``empty`` of a slot."""
    parts = slot_fields(value)
    return {"redirect": parts["t"] != 0xFF, "redirected_to": parts["s"] != 0, "empty": value == F.lit(-(1 << 56)).cast("long")}


def class_floors(page_bytes: int = 1024) -> list[int]:
    """Least free bytes of the 16 free-space classes of a page.

    The lower half doubles from a few bytes up to half of the usable bytes,
    the upper half rises in equal steps.
    """
    usable = page_bytes - PAGE_HEADER_BYTES
    half = usable // 2
    step = half // 8
    return [0, *(half >> i for i in range(6, -1, -1)), *(usable - step * i for i in range(7, -1, -1))]


def encode_free_space(free: Column, page_bytes: int = 1024) -> Column:
    """The largest class whose floor is not above ``free``."""
    out = F.lit(0)
    for number, floor in enumerate(class_floors(page_bytes)):
        out = F.when(free >= floor, number).otherwise(out)
    return out


def decode_free_space(number: Column, page_bytes: int = 1024) -> Column:
    """A class's floor."""
    return F.element_at(F.array(*map(F.lit, class_floors(page_bytes))), (number + 1).cast("int"))


def inventory_place(page: Column, page_bytes: int = 1024) -> tuple[Column, Column]:
    """Inventory page and entry of a data page: two four-bit entries a byte."""
    entries = 2 * page_bytes
    return F.floor(page / F.lit(entries)).cast("long"), F.pmod(page, F.lit(entries)).cast("long")


def inventory_page(pid: Column, segment: Column, pages: Column, page_bytes: int = 1024) -> Column:
    """``(pid, entry)`` of the inventory page in ``segment`` that has a data page's entry; null beyond the ``pages`` that exist."""
    page, entry = inventory_place(page_in_segment(pid), page_bytes)
    return F.when(page_in_segment(pid) < pages, F.struct(page_number(segment, page).alias("pid"), entry.alias("entry")))


def target_page(inventory_pid: Column, entry: Column, segment: Column, page_bytes: int = 1024) -> Column:
    """The data page in ``segment`` that an entry of an inventory page is about."""
    return page_number(segment, page_in_segment(inventory_pid) * (2 * page_bytes) + entry)


def hex_dump(data: Column, width: int = 16) -> Column:
    """An array of lines: offset, printable characters and hexadecimal bytes of a binary value.

    A line is ``0010 : text 74 65 78 74 ``, its text padded to ``width``; bytes
    below 0x20 and above 0x7F are shown as dots.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(width))

    def line(start):
        part = F.substring(data, start + 1, F.lit(width))
        pairs = F.regexp_replace(F.hex(part), "(..)", "$1 ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7F]", ".")
        offset = F.hex(start.cast("long"))
        return F.concat(F.lpad(offset, F.greatest(F.lit(4), F.length(offset)), F.lit("0")), F.lit(" : "), F.rpad(shown, width, " "), F.lit(" "), pairs)

    return F.when(F.octet_length(data) > 0, F.transform(starts, line)).otherwise(F.array().cast("array<string>"))
