"""Fixed values of the data model: severities of the named checks, status bits, options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ERROR, FATAL, WARN, INFO, IGNORE = "error", "fatal", "warn", "info", "ignore"

# The named checks by default severity.
CHECKS: dict[str, tuple[str, ...]] = {
    FATAL: ("nulInHeader", "unterminatedHeader"),
    ERROR: (
        "badDate", "badDateOverflow", "badEmail", "badName", "badObjectSha1", "badParentSha1", "badTimezone", "badTree",
        "badTreeSha1", "badType", "duplicateEntries", "missingAuthor", "missingCommitter", "missingEmail",
        "missingNameBeforeEmail", "missingObject", "missingSpaceBeforeDate", "missingSpaceBeforeEmail", "missingTag",
        "missingTagEntry", "missingTree", "missingType", "missingTypeEntry", "multipleAuthors", "treeNotSorted",
        "unknownType", "zeroPaddedDate", "gitmodulesMissing", "gitmodulesBlob", "gitmodulesLarge", "gitmodulesName",
        "gitmodulesSymlink", "gitmodulesUrl", "gitmodulesPath", "gitmodulesUpdate", "gitattributesMissing",
        "gitattributesLarge", "gitattributesLineLength", "gitattributesBlob", "badHeadTarget", "badPackedRefEntry",
        "badPackedRefHeader", "badReferentName", "badRefContent", "badRefFiletype", "badRefName", "badRefOid",
        "packedRefEntryNotTerminated", "packedRefUnsorted",
    ),
    WARN: (
        "emptyName", "fullPathname", "hasDot", "hasDotdot", "hasDotgit", "nullSha1", "zeroPaddedFilemode", "nulInCommit",
        "largePathname",
    ),
    INFO: (
        "badFilemode", "gitmodulesParse", "gitignoreSymlink", "gitattributesSymlink", "mailmapSymlink", "badTagName",
        "missingTaggerEntry", "emptyPackedRefsFile", "refMissingNewline", "symlinkRef", "symrefTargetIsNotARef",
        "trailingRefContent",
    ),
    IGNORE: ("extraHeaderEntry",),
}

DEFAULT_SEVERITY = {check: severity for severity, checks in CHECKS.items() for check in checks}

# The status bits of a run.
BIT_OBJECT, BIT_REACHABLE, BIT_PACK, BIT_REFS, BIT_COMMIT_GRAPH, BIT_MULTI_PACK, BIT_REV_INDEX, BIT_BITMAP = 1, 2, 4, 8, 16, 32, 64, 128
BIT_REF_CONTENT = 256
STATUS_FATAL, STATUS_USAGE = 128, 129


@dataclass(frozen=True)
class Options:
    """What a store check looks at and what it reports."""

    strict: bool = False
    full: bool = True
    connectivity_only: bool = False
    unreachable: bool = False
    dangling: bool = True
    tags: bool = False
    root: bool = False
    reflogs: bool = True
    cache: bool = False
    references: bool = True
    name_objects: bool = False
    lost_found: bool = False
    big_file: int = 512 << 20
    severities: dict[str, str] = field(default_factory=dict)
    skip: frozenset[str] = frozenset()

    def normal(self) -> "Options":
        """lost_found asks for a full check without reflogs as roots."""
        if not self.lost_found:
            return self
        return Options(**{**self.__dict__, "full": True, "reflogs": False})


def severities(overrides: dict[str, str] | None = None, strict: bool = False) -> dict[str, str]:
    """The severity of every check: defaults, strict making warnings errors, then overrides as they stand.

    Names are compared without case.  An unknown name or severity is refused, and so is
    making a fatal check anything but an error or fatal.
    """
    out = {k: (ERROR if strict and v == WARN else v) for k, v in DEFAULT_SEVERITY.items()}
    by_key = {k.lower(): k for k in out}
    for name, value in (overrides or {}).items():
        check, value = by_key.get(name.lower()), value.lower()
        if check is None:
            raise ValueError(f"unknown check: {name}")
        if value not in (ERROR, WARN, IGNORE):
            raise ValueError(f"unknown severity: {value}")
        if DEFAULT_SEVERITY[check] == FATAL and value != ERROR:
            raise ValueError(f"{check} cannot be made {value}")
        out[check] = value
    return out


def severity_table(spark: SparkSession, overrides: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """(msg_id, severity): one row for each of the 73 checks."""
    return spark.createDataFrame(sorted(severities(overrides, strict).items()), "msg_id string, severity string")
