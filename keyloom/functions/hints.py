"""Hints for error logs: patterns that are looked for in a whole log, and what each match suggests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands before a hint, and each pattern with the hint that its groups are put into.
PREFIX = "BENCHMARK HINT: "
HINTS = (
    (r"assert (\d+) == (\d+).*where \1 = <Response \[(\d+) OK\]>", "The test expects status code {1}, but the code returned {0}. Locate the route decorator (e.g., @app.post, @app.get) or the return statement and ensure it explicitly sets status_code={1}."),
    (r"assert (\d+) == (\d+)", "Assertion failed: Found {0}, but expected {1}. Check your logic to ensure the output matches {1}."),
    (r"SyntaxError: (.*)", "Syntax Error detected: {0}. Check for missing parentheses, colons, or indentation."),
    (r"KeyError: '(.*)'", "KeyError accessing '{0}'. Ensure the dictionary or object contains this key before accessing it, or use .get() with a default value."),
    (r"AttributeError: '(\w+)' object has no attribute '(\w+)'", "The object '{0}' does not have the attribute '{1}'. Check if you have the correct object type or if there is a typo in the attribute name."),
    (r"AttributeError: 'NoneType' object has no attribute '(\w+)'", "You are trying to access '{0}' on a None object. This usually means a previous function returned None unexpectedly. Check where this variable is assigned."),
    (r"TypeError: '(\w+)' object is not iterable", "You are trying to loop over or unpack a '{0}' object, which is not allowed. Check if you missed wrapping it in a list() or if the variable contains what you expect."),
    (r"(ImportError|ModuleNotFoundError): No module named '(.*)'", "Missing Import: The module '{1}' is not found. Add `import {1}` or `from ... import {1}` at the top of the file."),
    (r"IndexError: list index out of range", "IndexError: You are trying to access a list element that does not exist. Check if the list is empty or if your index is too large."),
    (r"SEC001", "SECURITY FIX: Hardcoded password detected. 1. Import os. 2. Replace string literal with os.getenv('PASSWORD_VAR'). 3. Do not leave empty lines."),
    (r"LINT001", "LINT FIX: Console print detected. 1. Import logging if missing. 2. Replace print(...) with logging.info(...). 3. Ensure syntax is valid."),
    (r"PERF001", "PERFORMANCE FIX: Infinite loop detected. You MUST add a `break` statement inside the loop or a termination condition."),
    (r"FileNotFoundError: \[Errno 2\] No such file or directory: '(.*)'", "FileNotFound: The file '{0}' was not found. 1. Check if the path is correct/absolute. 2. Verify the file exists before opening."),
    (r"NameError: name '(\w+)' is not defined", "NameError: The variable '{0}' is used but not defined. 1. Check for typos. 2. Ensure it is imported or initialized before use."),
    (r"IndentationError: (.*)", "IndentationError: {0}. Python relies on strict indentation. Ensure all blocks within functions/loops are indented consistently (4 spaces)."),
    (r"ValueError: not enough values to unpack \(expected (\d+), got (\d+)\)", "ValueError: Unpacking mismatch. You tried to unpack {1} values into {0} variables. Check the function return value."),
    (r"TypeError: \w+\(\) takes (\d+) positional arguments but (\d+) were given", "TypeError: Argument count mismatch. Function expects {0} arguments but received {1}. Check the function signature."),
    (r"json.decoder.JSONDecodeError: (.*)", "JSON Error: Failed to parse JSON. Result might be empty or malformed. Check if the response.text is valid JSON before calling .json()."),
    (r"ZeroDivisionError: division by zero", "ZeroDivisionError: You are trying to divide by zero. Ensure the denominator is not zero before division."),
    (r"UnboundLocalError: local variable '(\w+)' referenced before assignment", "UnboundLocalError: Variable '{0}' is referenced before assignment. Ensure it is initialized in all code paths before use."),
    (r"RecursionError: maximum recursion depth exceeded", "RecursionError: Infinite recursion detected. Check your base case and ensure recursive calls move towards it."),
    (r"ValueError: invalid literal for int\(\) with base 10: '(.*)'", "ValueError: Impossible to convert string '{0}' to integer. Ensure the string contains only digits."),
    (r"SEC002", "SECURITY FIX: Potential SQL Injection detected. 1. Use parameterized queries (e.g., `cursor.execute('SELECT * FROM users WHERE name = ?', (name,))`). 2. NEVER strictly concatenate strings into SQL queries."),
    (r"TimeoutError", "TimeoutError: Operation timed out. 1. Increase the timeout limit. 2. Optimize the query/request. 3. Ensure the external service is reachable."),
    (r"PermissionError: \[Errno 13\] Permission denied: '(.*)'", "PermissionError: Access denied to '{0}'. 1. Check file permissions. 2. Ensure the process has the necessary rights (e.g., Run as Admin/root). 3. Check if file is open in another program."),
    (r"ConnectionRefusedError: \[Errno 111\] Connection refused", "ConnectionRefused: Target machine refused the connection. 1. Ensure the server is running. 2. Check the port number. 3. specific firewall rules."),
)


def error_hints(log: Column) -> Column:
    """The distinct hints, sorted, of all matches of all patterns in a log, over line ends too; none for null or empty logs."""
    text = F.coalesce(log, F.lit(""))

    def of(pattern: str, hint: str) -> Column:
        # a hint is put together from its pieces, so a captured text is never read as a place for another
        pieces = re.split(r"\{(\d)\}", PREFIX + hint)
        if len(pieces) == 1:
            return F.when(text.rlike(pattern), F.array(F.lit(pieces[0]))).otherwise(F.array().cast("array<string>"))
        groups = sorted({int(g) for g in pieces[1::2]})
        found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit("(?sU)" + pattern), F.lit(g + 1)).alias(f"g{g}") for g in groups])
        return F.transform(found, lambda m: F.concat(*[F.lit(p) if i % 2 == 0 else m[f"g{p}"] for i, p in enumerate(pieces)]))

    return F.array_sort(F.array_distinct(F.flatten(F.array(*[of(p, h) for p, h in HINTS]))))
