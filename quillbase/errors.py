"""What the engine raises; the end of an iteration is an ordinary end of iteration."""


class EngineError(Exception):
    """Any failure of a call's contract."""


class TableExists(EngineError):
    pass


class NoSuchTable(EngineError):
    pass


class NoSuchAttribute(EngineError):
    pass


class NoSuchRid(EngineError):
    pass


class NoSuchIndex(EngineError):
    pass


class IndexExists(EngineError):
    pass


class NoSuchEntry(EngineError):
    pass


class SystemCatalogError(EngineError):
    """System tables can be read, not written."""


class TypeMismatch(EngineError):
    pass


class FileError(EngineError):
    """A file is there that should not be, or the other way round."""


class CommitConflict(EngineError):
    """Another writer committed this version first."""
