"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  ``registry`` holds the
``opN_<name>`` queries; each sibling module holds one operator.
"""
