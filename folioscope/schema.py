"""Fixed column layouts of manifest entries and reports."""

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
_LIST = T.ArrayType(_S)

VALIDATOR = _struct(compliant=_B, profile=_S, failed_checks=_I, passed_checks=_I, failed_rules=_LIST, error=_S)
REPORT = _struct(
    **dict.fromkeys("Accessible TotallyInaccessible BrokenFile Exempt".split(), _B),
    **dict.fromkeys("TaggedTest EmptyTextTest ProtectedTest TitleTest LanguageTest BookmarksTest Date".split(), _S),
    **dict.fromkeys("hasTitle hasDisplayDocTitle hasLang InvalidLang Form xfa hasBookmarks hasXmp".split(), _B),
    **dict.fromkeys("PDFVersion Creator Producer".split(), _S),
    **dict.fromkeys("Pages Words Images".split(), _I),
    veraPDF=VALIDATOR,
)
ENTRY = _struct(**dict.fromkeys("url md5 filename site crawled_at status".split(), _S), report=REPORT, errors=_LIST, notes=_S)
HISTORY = _struct(**dict.fromkeys("date site crawl_url run_url issue_url archive_file".split(), _S), **dict.fromkeys("total analysed accessible".split(), _L))
