"""Errors that carry a stable name, id and code."""

from __future__ import annotations

# Error ids and names by code.
PARSE = {
    "T0001": "UnexpectedChar", "T0002": "UnterminatedString", "T0003": "UnexpectedToken", "T0004": "UnexpectedEof", "T0005": "UnsupportedKeySpace", "T0006": "UnsupportedOperator",
    "T0007": "UnsupportedFunction", "T0008": "FunctionArityMismatch", "T0009": "NonImmutableConstruct", "T0010": "UnsupportedPredicate", "T0011": "AtLeastOneArgumentRequired",
    "T0012": "TooManyQualifiedNameParts", "T0013": "TooManyColumnNameParts", "T0014": "GroupByKeyNotFromSource", "T0015": "TableAlias", "T0016": "AliasedTableName",
    "T0017": "UnsupportedCastTarget", "T0018": "PrefixMinusChainTooLong", "T0019": "ReservedWord", "T0021": "DoubleMinus", "T0022": "NumericTrailingJunk", "T0023": "UnsupportedNumericForm",
    "T0024": "NonAssociativeComparison", "T0025": "UnsupportedIsForm", "T0026": "NotChainTooLong", "T0027": "SimpleCaseUnsupported", "T0029": "UnsupportedCastOperator",
    "T0030": "ExpressionTooDeep", "T0032": "UnterminatedQuotedIdentifier", "T0033": "ZeroLengthQuotedIdentifier", "T0034": "UnicodeEscapeIdentifier", "T0035": "UnsupportedQuotedIdentifier",
    "T0036": "NameTooLong", "T0038": "GrammarVersionTooOld", "T0039": "GrammarVersionTooNew", "T0240": "UnsupportedAggregateModifier", "T0248": "SubqueryInList", "T0249": "BetweenSymmetric",
    "T0250": "QuantifiedComparison", "T0251": "RowConstructor",
}
VALIDATION = {
    "T0028": "UnsupportedLiteralType", "T0040": "DuplicateFieldName", "T0041": "ReservedFieldName", "T0043": "FieldNamedAfterPrimaryKey", "T0044": "UnresolvedColumn", "T0045": "Cycle",
    "T0046": "FieldExpansionTooLarge", "T0047": "TableCycle", "T0048": "TargetEqualsSource", "T0050": "JoinSelf", "T0051": "JoinTooManyTables", "T0052": "JoinUnknownTable",
    "T0053": "JoinUnqualifiedColumn", "T0054": "JoinUnresolvedColumn", "T0055": "JoinOnSameSide", "T0056": "JoinMixedSideArgument", "T0057": "JoinOnRepeatedPair", "T0058": "JoinOnRepeatedColumn",
    "T0061": "JoinKeyTypeMismatch", "T0062": "JoinUnsupportedKeyType", "T0064": "JoinFieldShape", "T0065": "OneToOneJoinAggregate", "T0066": "OneToOneJoinKeyNotUnique",
    "T0067": "OneToOneJoinUnsupported", "T0068": "StarJoinTooManyTables", "T0069": "JoinOnReadsAnotherJoinedTable", "T0070": "DeferredAggregate", "T0071": "UnsupportedAggregateArgument",
    "T0072": "UnsupportedExtremeArgument", "T0073": "ExtremeOfExpression", "T0074": "ChainedExtreme", "T0075": "ExtremesWithoutSourceIndex", "T0078": "TypeMismatch",
    "T0079": "MixedFloatExactComparison", "T0080": "MixedTemporalComparison", "T0081": "TextOrderingComparison", "T0082": "ComparisonTypeMismatch", "T0083": "NullIfFirstArgumentCast",
    "T0084": "CaseConditionNotBoolean", "T0085": "CaseResultTypeMismatch", "T0086": "UntypedNull", "T0087": "ConstantDivisorZero", "T0088": "IntegerDivision", "T0089": "FloatModulo",
    "T0090": "TemporalOperand", "T0091": "TemporalLiteral", "T0092": "UnsupportedCast", "T0093": "NumericFunctionArgument", "T0094": "ScaleNotIntegerLiteral", "T0095": "FunctionArgTypeMismatch",
    "T0096": "NonLiteralRegexPattern", "T0097": "InvalidTypedLiteral", "T0099": "UnresolvedGroupByColumn", "T0100": "UnsupportedGroupByKeyType", "T0101": "GroupByKeysShareTargetColumn",
    "T0102": "UngroupedColumnReference", "T0103": "AggregateOfAggregateField", "T0104": "AmbiguousColumnReference", "T0105": "QualifiedColumnNotFromSource",
    "T0106": "GroupingColumnFieldMustBePassthrough", "T0113": "NoPrimaryKey", "T0115": "KeyOnTarget", "T0116": "KeyNotBacked", "T0117": "KeyDiffersFromReaders",
    "T0121": "UnsupportedPrimaryKeyType", "T0127": "InvalidRegexPattern", "T0132": "SourceKeyChanged", "T0143": "TargetNotAdoptable", "T0145": "PartitionedSource", "T0150": "TransformNotPaused",
    "T0153": "DependentsBlockDrop", "T0154": "TransformNotLive", "T0156": "AlterFieldAlreadyExists", "T0157": "UnsupportedAlter", "T0173": "ColumnNotPaused", "T0234": "PredicateNotBoolean",
    "T0235": "AggregateInPredicate", "T0236": "PredicateColumnNotFound", "T0237": "PredicateNotTotal", "T0239": "FilteredExtreme", "T0241": "EnumLiteralNotALabel", "T0243": "JoinPredicateReadsBothSides",
    "T0244": "JoinPredicateJoinedSideUnderLeft", "T0245": "JoinPredicateReadsNoColumn", "T0252": "InListCommonType", "T0253": "NullInNotNullKey",
}
NOT_FOUND = {"T0126": "SourceTableNotFound", "T0148": "TransformNotFound", "T0149": "NameCaseMismatch", "T0155": "AlterFieldNotFound", "T0178": "KeyNotHeld", "T0218": "ColumnNotFound"}
CONFLICT = {"T0141": "TargetTableExists"}
TIMEOUT = {"T0189": "ConvergenceTimeout"}

KNOWN = {name: (number, code) for code, names in (("Parse", PARSE), ("Validation", VALIDATION), ("NotFound", NOT_FOUND), ("Conflict", CONFLICT), ("Timeout", TIMEOUT)) for number, name in names.items()}


class EngineError(Exception):
    """A refusal or failure: ``name`` such as TypeMismatch, ``id`` such as T0078, ``code`` such as Validation."""

    def __init__(self, name: str, message: str):
        self.name = name
        self.id, self.code = KNOWN.get(name, ("T0000", "Internal"))
        super().__init__(f"{self.id} {name}: {message}")


def refuse(name: str, message: str) -> EngineError:
    """The error to raise; an unknown name is a bug."""
    assert name in KNOWN, name
    return EngineError(name, message)
