"""T-SQL: lexer, parser, and the syntax tree."""
