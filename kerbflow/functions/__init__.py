"""Scalar functions as SQL expressions over named inputs: evaluated JVM-side, inside code generation."""
