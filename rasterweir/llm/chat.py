"""Chat formatting with DataFrame functions only: turn-order automaton, template, loss flags, reading back.

A template gives each role a start mark and a flag that says whether its text is learnt from. A turn emits three segments:
mark, text and end; only the text of a role that is learnt from bears the loss flag. Control strings inside texts are
escaped by doubling: the marks begin with the ``control`` character, and each such character inside a text is written
twice, so no text can contain a mark, and halving gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that are put together before a conversation is, so that a long one is gathered in two steps.
BLOCK = 32


@dataclass(frozen=True)
class Template:
    """Declarative template.

    control: one character that begins all marks and is doubled inside texts. roles: role -> (mark, loss flag); a mark
    is ``control`` + letters + ``close``. end: closes a turn. order: state -> {role: next state}; ``start`` is the
    state before the first turn, and ``accept`` lists the states in which a conversation may end.
    """

    control: str = "<"
    close: str = ">"
    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("sys", False), "user": ("usr", False), "assistant": ("ast", True)})
    other: str = "oth"
    named: str = "as"
    end: str = "end"
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "set", "user": "asked"}, "set": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accept: tuple[str, ...] = ("asked", "answered")

    def mark(self, name: str) -> str:
        return self.control + name + self.close


def _escape(text: Column, t: Template) -> Column:
    return F.replace(text, F.lit(t.control), F.lit(t.control * 2))


def unescape(text: Column, template: Template | None = None) -> Column:
    """The text as it was before the control character was doubled."""
    t = template or Template()
    return F.replace(text, F.lit(t.control * 2), F.lit(t.control))


def _emit(role: Column, text: Column, t: Template) -> Column:
    """The three segments of a turn; a role the template doesn't know is written out before its text."""
    mark, loss = F.concat(F.lit(t.mark(t.other)), _escape(role, t), F.lit(t.mark(t.named))), F.lit(False)
    for name, (short, flag) in t.roles.items():
        mark, loss = F.when(role == name, F.lit(t.mark(short))).otherwise(mark), F.when(role == name, F.lit(flag)).otherwise(loss)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(segment(mark, F.lit(False)), segment(_escape(text, t), loss), segment(F.lit(t.mark(t.end)), F.lit(False)))


def _order_ok(roles: Column, t: Template) -> Column:
    """Runs the automaton over an array of roles; false where a turn has no transition or the end isn't accepted."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("bad")
        for before, moves in t.order.items():
            for name, after in moves.items():
                out = F.when((state == before) & (role == name), F.lit(after)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step).isin(*t.accept)


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted STRING, segments ARRAY<STRUCT<text, loss>>, valid BOOLEAN)``, one row per conversation.

    ``segments`` joined are ``formatted``; texts in them are escaped, and ``unescape`` gives them back. Turns in order of
    ``turn``; ties by role, then text; null turns first; null role or text counts as empty. A conversation whose order
    the automaton rejects is formatted as well, with ``valid`` false. Rows with a null id form one conversation. Repeated
    rows stay. A very long text or conversation is one row; its turns are gathered in blocks of BLOCK first. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    t = template or Template()
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / BLOCK).alias("block"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("row"))
    some = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", F.struct("block", "rows").alias("part"))
    whole = some.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts")).select("conv_id", F.flatten(F.col("parts.rows")).alias("rows"))
    out = whole.select("conv_id", F.flatten(F.transform("rows", lambda r: _emit(r["role"], r["text"], t))).alias("segments"), _order_ok(F.col("rows.role"), t).alias("valid"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "valid")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: ``ARRAY<STRUCT<role, text, loss>>``, texts unescaped.

    Doubled control characters are first put aside as a private pair that marks can't form, then the text is split
    at end marks, and each part is cut after its start mark.
    """
    t = template or Template()
    aside = t.control + "\u0001"  # a control character before \u0001 is no mark, and in texts it always stands double
    plain = F.replace(formatted, F.lit(t.control * 2), F.lit(aside))
    parts = F.filter(F.split(plain, "\\Q" + t.mark(t.end) + "\\E", -1), lambda x: x != "")
    back = lambda x: F.replace(x, F.lit(aside), F.lit(t.control))
    known = {t.mark(short): (name, flag) for name, (short, flag) in t.roles.items()}

    def turn(x: Column) -> Column:
        named = F.startswith(x, F.lit(t.mark(t.other)))
        role = F.substring_index(F.substring(x, len(t.mark(t.other)) + 1, F.length(x)), t.mark(t.named), 1)
        size, loss = F.length(role) + len(t.mark(t.other) + t.mark(t.named)), F.lit(False)
        role = back(role)
        for mark, (name, flag) in known.items():
            hit = F.startswith(x, F.lit(mark))
            role, loss, size = F.when(hit, F.lit(name)).otherwise(role), F.when(hit, F.lit(flag)).otherwise(loss), F.when(hit, F.lit(len(mark))).otherwise(size)
        return F.struct(role.alias("role"), back(F.substring(x, size + 1, F.length(x))).alias("text"), (loss & ~named).alias("loss"))

    return F.transform(parts, turn)
