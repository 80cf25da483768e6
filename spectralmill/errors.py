"""Errors that are part of the contract."""

from __future__ import annotations


class SpectralMillError(ValueError):
    """Base of all errors of this package."""


def _kind(name: str, text: str) -> type[SpectralMillError]:
    return type(name, (SpectralMillError,), {"__doc__": text, "__module__": __name__})


InvalidTransformation = _kind("InvalidTransformation", "A transformation with parameters it can't have.")
UnknownTransformation = _kind("UnknownTransformation", "No transformation has this name.")
IncompatibleArchiveVersion = _kind("IncompatibleArchiveVersion", "The archive was written in another version.")
WrongNumberOfColumns = _kind("WrongNumberOfColumns", "A line has more or fewer fields than its header.")
HeaderExpected = _kind("HeaderExpected", "A spectrum must start with a header line.")
WrongFormat = _kind("WrongFormat", "A line has no valid k-mer and count.")
UnknownCombinationCriterion = _kind("UnknownCombinationCriterion", "Neither mean nor median.")
ClassesLabelNotFound = _kind("ClassesLabelNotFound", "The metadata has no such field.")
ClassLabelIsAlsoSpectrumName = _kind("ClassLabelIsAlsoSpectrumName", "A class has the name of a spectrum.")
InvalidNumberOfClasses = _kind("InvalidNumberOfClasses", "There must be more than one class and fewer classes than spectra.")
EmptySelection = _kind("EmptySelection", "No spectrum is selected.")
UnknownType = _kind("UnknownType", "No matrix type has this name.")
IncompatibleMatrices = _kind("IncompatibleMatrices", "The matrices have different columns or types.")
UnexpectedType = _kind("UnexpectedType", "The archive holds a matrix of another type.")
UnknownAlgorithm = _kind("UnknownAlgorithm", "Neither gaps nor centroids.")
InvalidAcceptanceProbabilityAtZero = _kind("InvalidAcceptanceProbabilityAtZero", "Must lie between 0 and 1.")
InvalidDifferenceMagnificationFactor = _kind("InvalidDifferenceMagnificationFactor", "Must be positive.")
InsufficientElements = _kind("InsufficientElements", "At least two elements are needed.")
InvalidElement = _kind("InvalidElement", "The element isn't in the set.")
IncompatibleGeometries = _kind("IncompatibleGeometries", "Vectors or metrics have different numbers of dimensions.")
UnknownMetric = _kind("UnknownMetric", "No metric has this form.")
NegativePower = _kind("NegativePower", "A power must not be negative.")
InvalidThreshold = _kind("InvalidThreshold", "A threshold must lie between 0 and 1.")
IncompatibleVectorLengths = _kind("IncompatibleVectorLengths", "The vectors have different lengths.")
UnknownDistance = _kind("UnknownDistance", "No distance has this form.")
MismatchedTwisterFiles = _kind("MismatchedTwisterFiles", "Twister and inertia have different dimensions.")
IncompatibleTwisterAndTwisted = _kind("IncompatibleTwisterAndTwisted", "Twister and vectors have different dimensions.")
FloatExpected = _kind("FloatExpected", "A value is not a number.")
DuplicateLabel = _kind("DuplicateLabel", "The label is there already.")
InvalidContent = _kind("InvalidContent", "No k-mer content has this name.")
InvalidRegisterType = _kind("InvalidRegisterType", "No register has this name.")
InvalidKeepAtMost = _kind("InvalidKeepAtMost", "Must be a positive number or all.")
MixedInputs = _kind("MixedInputs", "FASTA and FASTQ inputs can't be mixed.")
DuplicateField = _kind("DuplicateField", "The metadata header has a field twice.")
