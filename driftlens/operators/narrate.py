"""One line on what a hunk did, as cascades over its facts.

Each function gives null where it has nothing to say, so a line is the first of several. Arguments are columns:

* names are arrays of strings, kept in their order;
* old_lines and new_lines count a hunk's rows of a side, zero where it has none;
* container is a name that ``label`` shortened, null where nothing encloses the hunk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.text import bare_name, quoted, unquote
from driftlens.operators.report import clipped, fitted

#: Names shown of a list, characters of a container, of a quoted token, of a condition and of a detail, fragments
#: of a removal, lines of an insertion that still reads as an edit.
SHOWN, CONTAINER, QUOTE, CONDITION, DETAIL, FRAGMENTS, SMALL = 3, 60, 30, 40, 80, 2, 3
#: How a guard leaves, and how each kind of removal reads.
EXITS = {"Return": "returns early", "Raise": "raises", "Throw": "throws", "Continue": "skips the iteration", "Break": "leaves the loop"}
REMOVED = {"def": "removes ", "section": "removes section ", "import": "removes import "}


def said(*parts: Column | str) -> Column:
    """Texts and columns joined; null if a column is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def label(name: Column) -> Column:
    """A container's name for a line: of a test's path the innermost quoted label, cut to the budget."""
    last = F.substring_index(name, " > ", -1)
    return clipped(F.when(name.contains(" > ") & last.rlike("[\"'`]"), last).otherwise(name), CONTAINER)


def listed(names: Column) -> Column:
    """The first names, shortened, and how many more; none: null."""
    head = F.array_join(F.transform(F.slice(names, 1, SHOWN), label), ", ")
    more = F.when(F.size(names) > SHOWN, said(", and ", (F.size(names) - SHOWN).cast("string"), " more")).otherwise("")
    return F.when(F.size(names) > 0, F.concat(head, more))


def lines(n: Column) -> Column:
    return F.when(n == 1, "1 line").otherwise(said(n.cast("string"), " lines"))


def placed(text: Column, preposition: str, container: Column) -> Column:
    """A text and where, if that is known."""
    return F.coalesce(said(text, f" {preposition} ", container), text)


def noise(noisy: Column, is_import: Column, imports: Column, removes: Column, new_lines: Column, moved: Column, generated: Column, copyright_: Column) -> Column:
    """Why a hunk can be skipped. An import that has more to say goes on: one that stays, is named, or was removed.
    moved: imports of the old rows that the new side still has."""
    speaks = is_import & ((new_lines > 0) | (F.size(imports) > 0) | removes)
    why = F.coalesce(F.when(is_import & (new_lines == 0), said("moves import ", listed(moved))), F.when(generated, "generated file").when(copyright_, "copyright notice").otherwise("formatting only"))
    return F.when(noisy & ~speaks, why)


def imported(is_import: Column, imports: Column, before: Column, renames: Column, new_lines: Column, moved: Column, reexport: Column) -> Column:
    """Adds, changes, moves, removes or renames imports. before: the old side's imports; renames: old name to a new name that
    the file imports; moved: whether the statement only changed its place."""
    noun = F.when(reexport, "re-export").otherwise("import")
    to = lambda n: F.try_element_at(renames, n)
    pairs = F.transform(F.filter(imports, lambda n: to(n).isNotNull()), lambda n: F.concat(n, F.lit(" → "), to(n)))
    gone = fitted(F.array_compact(F.array(said("renames import ", listed(pairs)), said("removes ", noun, " ", listed(F.filter(imports, lambda n: to(n).isNull()))))))
    verb = F.when(moved, "moves ").when(~F.arrays_overlap(imports, before), "adds ").otherwise("changes ")
    stays = F.when(F.size(imports) == 0, noun).otherwise(said(verb, noun, " ", listed(imports)))
    return F.when(is_import & (new_lines > 0), stays).when(is_import & (F.size(imports) > 0), gone)


def switched(shift: Column, removed: Column, old_lines: Column, container: Column) -> Column:
    """Code commented out, brought back, or replaced by comments. removed: what left, as ``removals`` says it, or null."""
    comment = F.when(old_lines == 1, "a comment").otherwise("comments")
    replaced = F.coalesce(said(removed, ", replaced by ", comment), placed(said("replaces ", lines(old_lines), " with ", comment), "in", container))
    return F.when(shift == "commented out", placed(F.lit("comments out code"), "in", container)).when(shift == "uncommented", placed(F.lit("uncomments code"), "in", container)).when(shift == "code to comment", replaced)


def commented(is_comment: Column, old_lines: Column, new_lines: Column, container: Column) -> Column:
    does = F.when(old_lines == 0, placed(F.lit("adds comment"), "to", container)).when(new_lines == 0, placed(F.lit("removes comment"), "from", container)).otherwise(placed(F.lit("edits comment"), "in", container))
    return F.when(is_comment, does)


def removals(gone: Column) -> Column:
    """What left, by kind, then what moved, by where to. gone: structs of kind (def, section, import, moved), name and path, in
    the order of their rows."""
    of = lambda kind: F.array_distinct(F.transform(F.filter(gone, lambda r: r["kind"] == kind), lambda r: r["name"]))
    kinds = F.array_compact(F.array(*[said(verb, listed(of(k))) for k, verb in REMOVED.items()]))
    left = F.filter(gone, lambda r: r["kind"] == "moved")
    to = lambda path: F.transform(F.filter(left, lambda r: r["path"] == path), lambda r: r["name"])
    moves = F.transform(F.array_distinct(F.transform(left, lambda r: r["path"])), lambda p: F.concat(F.lit("moves "), listed(to(p)), F.lit(" to "), p))
    every = F.concat(kinds, moves)
    more = F.when(F.size(every) > FRAGMENTS, said(", and ", (F.size(every) - FRAGMENTS).cast("string"), " more")).otherwise("")
    return F.when(F.size(every) > 0, F.concat(fitted(F.slice(every, 1, FRAGMENTS)), more))


def fits(token: Column) -> Column:
    """Short enough to quote, and more than punctuation."""
    return F.coalesce(token.rlike(r"[\p{L}\p{N}]") & (F.char_length(token) <= QUOTE), F.lit(False))


def function_in(func: Column, container: Column) -> tuple[Column, Column]:
    """The function that a pattern found, and where it is, as said from the container."""
    same = bare_name(container) == bare_name(func)
    what = F.when(func.isNull(), "a callback").when(same, container).otherwise(bare_name(func))
    return what, F.when(F.coalesce(same, F.lit(False)), "").otherwise(said(" in ", container))


def intent(i: Column, container: Column) -> Column:
    """A phrase for each pattern. i: a struct of tag, old, new, text, word, count, flag, func; what they hold by tag:

    Guard: text the condition, word the exit (or a label to jump to); WrapsTry: text the call, count the lines, word the
    construct, new what is caught; Condition: text the clause, word narrows or widens, flag whether it was added; Boundary: old
    and new, text and word the operators; Inverts: old, new; NamesLiteral: old the literal, new the name; DefaultParam: text the
    parameter, func; Async: flag whether it was added, func; SwapsCall: old, new; ReplacedByCall: new the call, word the
    construct, count the lines."""
    at = said(" in ", container)
    old, new, text, word, count = i["old"], i["new"], i["text"], i["word"], i["count"]
    exits = F.coalesce(F.create_map(*[F.lit(x) for kv in EXITS.items() for x in kv])[word], said("jumps to ", word))
    both = fits(old) & fits(new)
    who, where = function_in(i["func"], container)
    tried = F.when(fits(text), said(text, "()")).otherwise(lines(count))
    plain = text.rlike(r"^[\p{L}\p{N}_$]*$") & fits(text)
    return (
        F.when(i["tag"] == "Guard", F.when(F.char_length(text) <= CONDITION, said(exits, " when ", text, at)).otherwise(said("adds a guard clause to ", container)))
        .when(i["tag"] == "WrapsTry", said("wraps ", tried, " in ", word, F.when(fits(new), said(" ", new)).otherwise(""), at))
        .when(i["tag"] == "Condition", said(word, " condition", F.when(~fits(text), "").when(i["flag"], said(" with ", text)).otherwise(said(" by dropping ", text)), at))
        .when(i["tag"] == "Boundary", said("changes boundary ", F.when(both, old).otherwise(text), " → ", F.when(both, new).otherwise(word), at))
        .when(i["tag"] == "Inverts", said("inverts condition", F.when(both, said(" ", old, " → ", new)).otherwise(""), at))
        .when((i["tag"] == "NamesLiteral") & fits(new), said("replaces ", F.when(fits(old), old).otherwise("a literal"), " with constant ", new, at))
        .when(i["tag"] == "DefaultParam", said("adds ", F.when(plain, said("optional parameter ", text)).otherwise("an optional parameter"), " to ", who, where))
        .when(i["tag"] == "Async", said("makes ", who, F.when(i["flag"], " async").otherwise(" synchronous"), where))
        .when((i["tag"] == "SwapsCall") & both, said("calls ", new, " instead of ", old, at))
        .when((i["tag"] == "ReplacedByCall") & fits(new), said("replaces ", F.coalesce(said("a ", word), said(count.cast("string"), " lines")), " with a call to ", new, at))
    )


def single(role: Column, old: Column, new: Column, container: Column) -> Column:
    """The one literal, name or argument that a small edit changed."""
    at = said(" in ", container)
    both = fits(old) & fits(new)
    argument = lambda t: F.regexp_replace(t, r"^[,\s]+|[,\s]+$", "")
    return (
        F.when(role.isin("Num", "Bool") & both, said("changes ", old, " → ", new, at))
        .when((role == "Str") & both, said("changes ", quoted(unquote(old)), " → ", quoted(unquote(new)), at))
        .when((role == "Str") & (old != "") & (new != ""), said("changes a string", at))
        .when((role == "Ident") & both, said("replaces ", old, " with ", new, at))
        .when((role == "Arg") & (old == "") & fits(argument(new)), said("adds argument ", argument(new), at))
        .when((role == "Arg") & (new == "") & fits(argument(old)), said("removes argument ", argument(old), at))
    )


def value(names: Column, declared: Column, role: Column, old: Column, new: Column) -> Column:
    """``changes NAME: old → new`` where the literal is the whole value of the only name declared. declared: the text left of it."""
    name = F.get(names, F.lit(0))
    declares = F.array_contains(F.split(declared, r"[^\p{L}\p{N}_$-]"), bare_name(name))
    side = lambda t: F.when(role == "Str", quoted(clipped(unquote(t), QUOTE))).when(role.isin("Num", "Bool"), clipped(t, QUOTE))
    return F.when((F.size(names) == 1) & declares & (old != "") & (new != "") & (side(old) != side(new)), said("changes ", name, ": ", side(old), " → ", side(new)))


def members(details: Column, old_lines: Column, new_lines: Column, whole: Column, replaced: Column) -> Column:
    """The first details that name members added or removed, two where both fit. whole: the hunk adds its whole container;
    replaced: where its lines came back, or null."""
    verb = F.when((old_lines == 0) & ~whole, "adds").when((new_lines == 0) & replaced.isNull(), "removes")
    named = F.filter(details, lambda d: d.startswith(verb) & (F.octet_length(d) <= DETAIL))
    a, b = F.get(named, F.lit(0)), F.get(named, F.lit(1))
    return F.when(verb.isNotNull(), F.when(F.octet_length(a) + 2 + F.octet_length(b) <= DETAIL, said(a, "; ", b)).otherwise(a))


def contained(container: Column, old_lines: Column, new_lines: Column, whole: Column, conditional: Column, pattern: Column, one: Column) -> Column:
    """What a hunk did to its container: adds it, adds a conditional block, a pattern, a single change, an edit, or lines.
    conditional: the directive of a block that the hunk adds whole, or null."""
    block = F.when(conditional.endswith("\\"), said("an ", F.regexp_extract(conditional, r"^\s*(\S*)", 1), " block")).otherwise(conditional)
    size = F.when((old_lines > 0) | (new_lines <= SMALL), said("edits ", container)).otherwise(said("adds ", new_lines.cast("string"), " lines to ", container))
    return F.coalesce(F.when(whole, said("adds ", container)), said("adds ", block, " to ", container), pattern, one, size)


def sized(old_lines: Column, new_lines: Column, directive: Column, replaced: Column) -> Column:
    """Lines added, edited, removed or replaced, or the directive that came or went."""
    took = F.when((new_lines == 0) & replaced.isNull(), said("removes ", directive)).when(old_lines == 0, said("adds ", directive))
    gone = F.coalesce(said("replaces ", lines(old_lines), ", added ", replaced), said("removes ", lines(old_lines)))
    least = lines(F.greatest(new_lines, F.lit(1)))
    return F.coalesce(took, F.when((new_lines == 0) & (old_lines > 0), gone).when(old_lines == 0, said("adds ", least)).otherwise(said("edits ", least)))


def shaped(inserted: Column, container: Column, emptied: Column, removed: Column, member: Column, size: Column) -> Column:
    """The line of a hunk that nothing else spoke for. inserted: no old rows; container: ``contained`` or null; emptied: the hunk
    takes the file's whole text from its first line; removed: ``removals``; member: ``members``; size: ``sized``."""
    return F.coalesce(F.when(inserted, member), container, F.when(emptied, "deletes the file"), removed, member, size)
