"""Errors by kind."""


class EngineError(Exception):
    pass


class StorageError(EngineError):
    pass


class EmbedError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class ParseError(EngineError):
    pass


class NotFound(EngineError):
    pass
