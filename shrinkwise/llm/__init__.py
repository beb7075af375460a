"""Operations on the texts of a file estate for preparing training data.

Nothing outside this folder imports it. Every operator works on the library's file records: `rel_path`
identifies a file (any orderable type, also a struct), `text` or `content` holds what was read from it.
"""
