from pyspark.sql import Column, functions as F

# The code points that Unicode calls White_Space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of whitespace at both ends; ``trim`` alone knows only the space.

    Nearly all ids begin and end with a printable ASCII character. Those skip the search through
    the whitespace set, which would cost more than the rest of the row's clean-up.
    """
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    nothing_to_trim = first.between(33, 126) & last.between(33, 126)
    return F.when(nothing_to_trim, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))
