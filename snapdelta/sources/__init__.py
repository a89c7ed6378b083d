"""Readers of captured reports, trees and files as DataFrames."""
